"""What a plan asks the vocabulary: terms by field, cleaned and merged, and the scored codes that come back."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftworks.functions.text import normal

#: Words for people that name no diagnosis.
GENERIC_PEOPLE = ("patients", "patient", "participants", "participant", "subjects", "subject", "people", "person", "individuals", "individual", "volunteers", "volunteer", "adults", "adult", "children", "child", "healthy", "normal")
#: Fields whose codes a dataset can be scored by.
SCORED_FIELDS = ("diagnosis", "task", "datatype", "suffix")


def merge_requests(requests: Iterable[tuple[str, Iterable[str]]]) -> dict[str, list[str]]:
    """Terms per field, fields and terms in order of their first mention, equal terms of a field once; diagnoses without words that only say that there are people.
    Fields without a term left are left out. A plan has few terms, so this is plain Python."""
    out: dict[str, dict[str, None]] = {}
    for field, terms in requests:
        kept = [t for t in terms if field != "diagnosis" or t.strip().lower() not in GENERIC_PEOPLE]
        if kept:
            out.setdefault(field, {}).update(dict.fromkeys(kept))
    return {field: list(terms) for field, terms in out.items()}


def merged_requests(requests: DataFrame) -> DataFrame:
    """The same over a log of requests: (query, field, terms) from rows (query, position, field, term), terms in order of their first mention. NULL terms and
    fields are left out; repeated rows change nothing."""
    kept = requests.filter(F.col("field").isNotNull() & F.col("term").isNotNull() & ((F.col("field") != "diagnosis") | ~normal(F.col("term")).isin(*GENERIC_PEOPLE)))
    first = kept.groupBy("query", "field", "term").agg(F.min("position").alias("position"))
    return first.groupBy("query", "field").agg(F.array_sort(F.collect_list(F.struct("position", "term"))).alias("t")).select("query", "field", F.transform("t", lambda x: x["term"]).alias("terms"))


def best_scores(scores: DataFrame) -> DataFrame:
    """(field, code, score): the best score of each code of a field."""
    return scores.groupBy("field", "code").agg(F.max("score").alias("score"))


def scored_codes(resolved: DataFrame, scores: DataFrame) -> DataFrame:
    """(field, code, score): the codes of the fields that datasets are scored by, each once, with its best score, 1 where none is known. No scores at all give no rows.

    `resolved` is (field, code), `scores` (field, code, score)."""
    best = best_scores(scores)
    some = scores.select(F.lit(1).alias("_some")).limit(1)
    codes = resolved.filter(F.col("field").isin(*SCORED_FIELDS)).select("field", "code").distinct()
    return codes.join(F.broadcast(some)).join(best, ["field", "code"], "left").select("field", "code", F.coalesce("score", F.lit(1.0)).alias("score"))
