"""Sources mixed to target shares by weighted fair queueing.

Every document of a source gets a place in the source's shuffled queue; the virtual finish time of its n-th use is the source's cumulative tokens up to that use,
divided by the source's weight. Sorted by finish time, any beginning of the queue holds the sources in their target shares; it is cut at the total
budget. Cumulative sums are made by range partitions: sums within partitions, plus offsets from one row per partition and source. So
no source is ever in one task, and texts are read once, for their size, and never moved.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftworks.session import cut, spread

#: The byte-level pattern of the vocabulary is read from the tokenizer package; this is its module and the vocabulary's file.
TOKENIZER = "byte_bpe_50k.tiktoken"
SEED = 20_240_501
#: Offsets beyond this number aren't broadcast (about 30 bytes each).
BROADCAST_ROWS = 500_000


@lru_cache(2)
def _encoding(name: str):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counter(name: str = TOKENIZER):
    """A vectorised column function: tokens of a text by the public vocabulary `name`; NULL counts as no token."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        encoding = _encoding(name)
        return pd.Series([0 if t is None else len(encoding.encode_ordinary(t)) for t in texts], dtype="int64")

    return count


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the running sum of column 1 per value of column 0, within one partition."""
    carried: dict[object, int] = {}
    for batch in batches:
        frame = batch.select([0, 1]).to_pandas()
        key = frame.iloc[:, 0].astype(object).where(frame.iloc[:, 0].notna(), None)
        sums = frame.iloc[:, 1].groupby(key, dropna=False).cumsum() + key.map(lambda k: carried.get(k, 0))
        # Sums only grow: a group's last one is its largest.
        for k, v in sums.groupby(key, dropna=False).max().items():
            carried[None if pd.isna(k) else k] = v
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums.astype("int64"), pa.int64())], names=[*batch.schema.names, "running"])


def prefix_sums(df: DataFrame, group: str, value: str, order: list[Column]) -> DataFrame:
    """`df` in global order of `order`, with `running`: the sum of `value` over the rows of the same `group` up to and including the row.

    `order` must be total. The driver gets one row per partition and group: with few groups that is bounded by the number of partitions.
    """
    names = [group, value, *[c for c in df.columns if c not in (group, value)]]
    placed = df.select(*names).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = T.StructType([*placed.schema.fields, T.StructField("running", T.LongType())])
    # Partition numbers and sums must not change between the two reads below.
    local = cut(placed.mapInArrow(_running, schema))
    sums = local.groupBy("part", group).agg(F.max("running").alias("total")).orderBy("part").collect()
    before: dict[object, int] = {}
    rows = []
    for r in sums:
        rows.append((r["part"], r[group], before.get(r[group], 0)))
        before[r[group]] = before.get(r[group], 0) + r["total"]
    offsets = df.sparkSession.createDataFrame(rows, T.StructType([T.StructField("o_part", T.IntegerType()), T.StructField("o_group", local.schema[group].dataType), T.StructField("offset", T.LongType())]))
    # Very many partitions and groups: a plain join.
    side = F.broadcast(offsets) if len(rows) <= BROADCAST_ROWS else offsets
    joined = local.join(side, (F.col("part") == F.col("o_part")) & F.col(group).eqNullSafe(F.col("o_group")))
    return joined.select(*df.columns, (F.col("running") + F.col("offset")).alias("running"))


def _sized(docs: DataFrame, id_column: str, text_column: str, source_column: str, tokenizer: str) -> DataFrame:
    return spread(docs.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), F.col(text_column).alias("text"))).select("id", "source", token_counter(tokenizer)("text").alias("tokens"))


def plan(sizes: dict[str, int], targets: dict[str, tuple[float, int]], budget: int | None = None) -> tuple[dict[str, float], int]:
    """Weights of the sources that have tokens and a positive target, summing to 1, and the budget in tokens: the one given, else the largest for which
    every such source can reach its share within its repeats."""
    usable = {s: t for s, (t, repeats) in targets.items() if t and t > 0 and repeats and repeats > 0 and sizes.get(s, 0) > 0}
    total = sum(usable.values())
    weights = {s: t / total for s, t in usable.items()}
    most = min((sizes[s] * targets[s][1] / w for s, w in weights.items()), default=0)
    return weights, int(most) if budget is None else budget


def mix(docs: DataFrame, targets: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", budget: int | None = None, tokenizer: str = TOKENIZER, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The mixture and its report.

    Mixture: (id, use, source, tokens, finish, position_tokens), one row per use of a document; `use` counts from 1 to at most the source's max_repeats, and no document comes
    a second time before every document of its source came once. In order of (finish, source, use, id) any beginning holds the target shares.
    `position_tokens` is the running total, at most the budget.

    Report: (source, target_share, weight, available_tokens, max_repeats, documents, uses, tokens, share): one row per source of either table; `weight` is the target over the sources that
    can supply it. Sources without target or tokens supply nothing and are reported; a NULL source is one of them. NULL texts have no tokens. Ties in the
    shuffle are broken by id; repeated rows of a document are separate documents; repeated target rows of a source keep the largest share; empty tables give an empty mixture.
    If a given budget exceeds what a source can supply, the others go on and the report shows the shares reached.
    """
    spark = docs.sparkSession
    sized = cut(_sized(docs, id_column, text_column, source_column, tokenizer))
    goals = targets.filter(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("g")).select("source", "g.*")
    # One row per target: a configuration table.
    wanted = {r["source"]: (r["target_share"], r["max_repeats"]) for r in goals.collect()}
    totals = sized.groupBy("source").agg(F.sum("tokens").alias("available_tokens"), F.count(F.lit(1)).alias("documents"))
    sizes = {r["source"]: r["available_tokens"] for r in totals.filter(F.col("source").isin(list(wanted))).collect()}
    weights, total = plan(sizes, wanted, budget)
    chosen = spark.createDataFrame([(s, w, sizes[s], int(wanted[s][1])) for s, w in weights.items()], "source string, weight double, size long, max_repeats long")
    queue = sized.join(F.broadcast(chosen.select("source")), "source", "left_semi").withColumn("shuffle", F.xxhash64("id", F.lit(seed)))
    queue = prefix_sums(queue, "source", "tokens", [F.col("source"), F.col("shuffle"), F.col("id")])
    uses = queue.join(F.broadcast(chosen), "source").filter(F.col("running") <= total)
    # Uses beyond the budget can't be in the mixture, whatever is allowed: a source supplies at most the whole budget.
    most = F.least(F.col("max_repeats"), F.floor((F.lit(total) - F.col("running")) / F.col("size")) + 1)
    uses = uses.withColumn("use", F.explode(F.sequence(F.lit(1).cast("long"), most))).withColumn("queued", F.col("running") + (F.col("use") - 1) * F.col("size"))
    uses = uses.withColumn("finish", F.col("queued") / F.col("weight"))
    ranked = prefix_sums(uses.select("id", "use", "source", "tokens", "finish").withColumn("all", F.lit(0)), "all", "tokens", [F.col("finish"), F.col("source"), F.col("use"), F.col("id")])
    mixture = ranked.filter(F.col("running") <= total).select("id", "use", "source", "tokens", "finish", F.col("running").alias("position_tokens"))
    reached = mixture.groupBy("source").agg(F.count(F.lit(1)).alias("uses"), F.sum("tokens").alias("used"))
    rows = goals.join(totals, "source", "full").join(chosen.select("source", "weight"), "source", "left").join(reached, "source", "left")
    used = F.coalesce("used", F.lit(0))
    # The sum over one row per source.
    whole = rows.agg(F.sum(used).alias("whole"))
    report = rows.crossJoin(F.broadcast(whole)).select(
        "source", "target_share", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"), "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("uses", F.lit(0)).alias("uses"), used.alias("tokens"), F.when(F.col("whole") > 0, used / F.col("whole")).otherwise(0.0).alias("share"),
    )
    return mixture, report


