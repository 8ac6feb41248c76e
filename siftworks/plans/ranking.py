"""Relevance, order and pages of a result."""

from __future__ import annotations

import hashlib
import json
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import Window

from siftworks.plans.catalogue import Catalogue
from siftworks.plans.compiler import compile_plan
from siftworks.plans.plan import QueryPlan, ScoredCode, to_json

#: Fields of scored codes and the table that holds them.
SCORED = {"diagnosis": "participants", "task": "objects", "datatype": "objects", "suffix": "objects"}
DEFAULT_SIZE, LARGEST_SIZE = 20, 100


def merge_scores(codes: list[ScoredCode]) -> list[ScoredCode]:
    """One entry per field and code with its best score; other fields than the scored ones are left out."""
    best: dict[tuple[str, str], float] = {}
    for c in codes:
        if c.field in SCORED:
            best[c.field, c.code] = max(c.score, best.get((c.field, c.code), 0.0))
    return [ScoredCode(f, c, s) for (f, c), s in best.items()]


def hits(cat: Catalogue, codes: list[ScoredCode]) -> DataFrame:
    """(dataset_id, field, code) once per dataset: which scored codes a dataset holds."""
    parts = []
    for name in dict.fromkeys(SCORED.values()):
        fields = sorted({c.field for c in codes if SCORED[c.field] == name})
        for f in fields:
            wanted = [c.code for c in codes if c.field == f]
            parts.append(getattr(cat, name).filter(F.col(f).isin(wanted)).select("dataset_id", F.lit(f).alias("field"), F.col(f).alias("code")).distinct())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def relevance(base: DataFrame, cat: Catalogue, codes: list[ScoredCode]) -> DataFrame:
    """`base` with `relevance_score`: the sum of the scores of the codes a dataset holds, 0 if none."""
    codes = merge_scores(codes)
    if not codes:
        return base.withColumn("relevance_score", F.lit(0.0))
    scores = base.sparkSession.createDataFrame([(c.field, c.code, c.score) for c in codes], "field string, code string, score double")
    summed = hits(cat, codes).join(F.broadcast(scores), ["field", "code"]).groupBy("dataset_id").agg(F.sum("score").alias("_sum")).withColumnRenamed("dataset_id", "_of")
    return base.join(summed, F.col("id") == F.col("_of"), "left").withColumn("relevance_score", F.round(F.coalesce("_sum", F.lit(0.0)), 4)).drop("_sum", "_of")


def ordered(ranked: DataFrame) -> DataFrame:
    return ranked.orderBy(F.desc("relevance_score"), F.desc_nulls_last("subject_count"), F.asc("id"))


def clamp(page: int | None, size: int | None) -> tuple[int, int]:
    """Page from 1; size 20 where none is given, within 1..100."""
    return max(1, page or 1), min(LARGEST_SIZE, max(1, size or DEFAULT_SIZE))


def page_of(df: DataFrame, page: int | None = 1, size: int | None = None) -> DataFrame:
    """One page of an ordered result: a top-k of offset + size rows, whatever the result's size."""
    page, size = clamp(page, size)
    return df.offset((page - 1) * size).limit(size)


def page_counts(total: int, page: int, size: int) -> dict[str, int | bool]:
    return {"total": total, "page_count": max(1, -(-total // size)), "has_more": page * size < total}


def paging(total: Column, page: int, size: int) -> tuple[Column, Column]:
    """(page_count, has_more) of a column of totals."""
    page, size = clamp(page, size)
    return F.greatest(F.lit(1).cast("long"), F.ceil(total / size)).alias("page_count"), (F.lit(page * size) < total).alias("has_more")


def participants_of(cat: Catalogue, page: DataFrame, most: int = 50) -> DataFrame:
    """Up to `most` participants per dataset of a page, in order of participant id."""
    people = cat.participants.drop("crawled_at").dropDuplicates(["id"])
    wanted = people.join(page.select(F.col("id").alias("dataset_id")), "dataset_id", "left_semi")
    w = Window.partitionBy("dataset_id").orderBy("participant_id", "id")
    return wanted.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= most)


@dataclass
class Entry:
    ranked: DataFrame | None
    total: int | None
    created: float
    pages: dict[tuple[int, int], list[Row]] = field(default_factory=dict)


@dataclass
class QueryCache:
    """Results by id: expired entries go first, then the oldest; reading doesn't renew an entry. A ranked result is kept on the executors (memory, else disk) until its
    entry goes, so further pages rank nothing again; what an executor loses is computed again. At most `most` results are kept, each with a few pages of rows here."""

    ttl: float = 1800.0
    most: int = 500
    clock: Callable[[], float] = time.time
    entries: OrderedDict[str, Entry] = field(default_factory=OrderedDict)

    def _drop(self, key: str) -> None:
        entry = self.entries.pop(key)
        if entry.ranked is not None:
            entry.ranked.unpersist()

    def get(self, key: str) -> Entry | None:
        entry = self.entries.get(key)
        if entry and self.clock() - entry.created > self.ttl:
            self._drop(key)
            return None
        return entry

    def put(self, key: str, ranked: DataFrame | None) -> None:
        now = self.clock()
        if key in self.entries:
            self._drop(key)
        for old in [k for k, e in self.entries.items() if now - e.created > self.ttl]:
            self._drop(old)
        while len(self.entries) >= self.most:
            self._drop(min(self.entries, key=lambda k: self.entries[k].created))
        self.entries[key] = Entry(None if ranked is None else ranked.persist(StorageLevel.MEMORY_AND_DISK), None, now)


class Search:
    """`search` compiles, ranks and gives the first page; `page` gives further pages of the same result, the pages beside it being fetched with it."""

    #: Pages of rows kept per result.
    KEPT_PAGES = 9

    def __init__(self, cat: Catalogue, cache: QueryCache | None = None):
        self.cat, self.cache = cat, cache or QueryCache()

    def search(self, plan: QueryPlan, page: int = 1, size: int | None = None) -> tuple[str, DataFrame, dict]:
        key = hashlib.md5(json.dumps(to_json(plan), sort_keys=True).encode()).hexdigest()
        if self.cache.get(key) is None:
            result = compile_plan(plan, self.cat)
            # An order or limit asked for replaces relevance.
            self.cache.put(key, result if plan.order_by or plan.limit else ordered(relevance(result, self.cat, list(plan.scored))))
        return key, *self.page(key, page, size)

    def page(self, key: str, page: int = 1, size: int | None = None) -> tuple[DataFrame, dict]:
        """KeyError where the result has expired."""
        entry = self.cache.get(key)
        if entry is None:
            raise KeyError(key)
        page, size = clamp(page, size)
        if entry.total is None:
            entry.total = entry.ranked.count()
        if (page, size) not in entry.pages:
            first = max(1, page - 1)
            # The page and its neighbours in one job of at most three pages.
            rows = entry.ranked.offset((first - 1) * size).limit((page + 2 - first) * size).collect()
            while len(entry.pages) > self.KEPT_PAGES:
                entry.pages.pop(next(iter(entry.pages)))
            for p in range(first, page + 2):
                entry.pages[p, size] = rows[(p - first) * size : (p - first + 1) * size]
        return entry.ranked.sparkSession.createDataFrame(entry.pages[page, size], entry.ranked.schema), page_counts(entry.total, page, size)
