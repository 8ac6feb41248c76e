"""Per-key results over keys of very unequal size, by fragment and replicate.

1. Rows per key are counted (map-side pre-aggregated). Keys whose load exceeds a share of the ideal task load are
   *large*; there are at most `slots * split_at` of them whatever the data size. All other keys are summed into a fixed
   number of hash bins, so the driver sees a bounded load histogram, never the keys.
2. Large keys are cut into shards of at most one ideal share each and, with the bins, packed onto tasks by
   longest-processing-time-first.
3. Every row gets its task: small keys by their bin, rows of large keys by a hash of the row's identity over the key's
   shards. `repartitionById` sends task t to partition t, so the packing is what runs.
4. The matching side is replicated to exactly the shards of each large key (`replicate`), and goes once for other keys.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftworks.session import cut, task_slots

_SEED_BIN = 7
_SEED_SHARD = 11


@dataclass(frozen=True)
class LoadPlan:
    """Where rows go: `bins[b]` is the task of small-key bin b, `shards[key]` the tasks of a large key's shards. `total` is the number of rows counted."""

    slots: int
    bins: tuple[int, ...]
    shards: dict[object, tuple[int, ...]]
    loads: tuple[int, ...]
    total: int = 0


def pack(slots: int, bin_loads: dict[int, int], large: dict[object, int], n_bins: int) -> LoadPlan:
    """Longest-processing-time-first packing of shards of large keys and of bins of small keys onto `slots` tasks.

    A large key's shards go to distinct tasks. Empty input gives an all-zero plan.
    """
    total = sum(bin_loads.values()) + sum(large.values())
    share = max(1, -(-total // slots))
    heap = [(0, t) for t in range(slots)]
    heapq.heapify(heap)
    loads = [0] * slots
    items: list[tuple[int, str, object]] = []
    for key, load in large.items():
        n = min(slots, max(1, -(-load // share)))
        items += [(-(-load // n), f"{key!r}/{i}", ("key", key)) for i in range(n)]
    items += [(load, f"bin{b:06d}", ("bin", b)) for b, load in bin_loads.items()]
    shards: dict[object, list[int]] = {}
    bins = [b % slots for b in range(n_bins)]
    for load, _, (kind, which) in sorted(items, key=lambda x: (-x[0], x[1])):
        held = []
        while True:
            at, t = heapq.heappop(heap)
            if kind == "bin" or t not in shards.get(which, ()):
                break
            held.append((at, t))
        for h in held:
            heapq.heappush(heap, h)
        heapq.heappush(heap, (at + load, t))
        loads[t] += load
        if kind == "bin":
            bins[which] = t
        else:
            shards.setdefault(which, []).append(t)
    return LoadPlan(slots, tuple(bins), {k: tuple(v) for k, v in shards.items()}, tuple(loads), total)


def estimate(df: DataFrame, key: str, slots: int | None = None, bins_per_slot: int = 16, split_at: float = 4.0) -> LoadPlan:
    """Count the rows of every key and pack them. A key is large from `total / (slots * split_at)` rows on.

    The driver receives at most `slots * split_at` large keys plus `slots * bins_per_slot` bins. NULL is a key like any other.
    """
    slots = slots or task_slots(df.sparkSession)
    n_bins = slots * bins_per_slot
    # One narrow row per key, written once: the rows are read a single time.
    counts = cut(df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(1.0, total / (slots * split_at))
    large_side = F.col("n") >= F.lit(limit)
    histogram = (
        counts.groupBy(
            F.when(large_side, F.col("k")).alias("k"),
            large_side.alias("large"),
            F.when(~large_side, F.pmod(F.xxhash64("k", F.lit(_SEED_BIN)), F.lit(n_bins))).alias("b"),
        )
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    return pack(slots, {r["b"]: r["n"] for r in histogram if not r["large"]}, {r["k"]: r["n"] for r in histogram if r["large"]}, n_bins)


def _lookup(df: DataFrame, plan: LoadPlan, key: str) -> DataFrame:
    """Adds `_tasks` (the shards of a large key, else NULL) from a map bounded by the number of large keys."""
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    rows = [(k, list(t)) for k, t in plan.shards.items()]
    large = spark.createDataFrame(rows, f"_k {kind}, _tasks array<int>")
    return df.join(F.broadcast(large), F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")


def _bin_task(plan: LoadPlan, key: Column) -> Column:
    n_bins = len(plan.bins)
    # One literal, however many bins there are.
    bins = F.from_json(F.lit(json.dumps(plan.bins)), "array<int>")
    return F.element_at(bins, (F.pmod(F.xxhash64(key, F.lit(_SEED_BIN)), F.lit(n_bins)) + 1).cast("int"))


def place(df: DataFrame, plan: LoadPlan, key: str, spread: list[str]) -> DataFrame:
    """`df` with `_task`, rows moved so that partition t holds task t. Rows equal in `spread` stay together."""
    _reserved(df)
    shard = F.pmod(F.xxhash64(*spread, F.lit(_SEED_SHARD)), F.size("_tasks")).cast("int")
    task = F.when(F.col("_tasks").isNotNull(), F.element_at("_tasks", shard + 1)).otherwise(_bin_task(plan, F.col(key)))
    return _lookup(df, plan, key).withColumn("_task", task).drop("_tasks").repartitionById(plan.slots, F.col("_task"))


def replicate(df: DataFrame, plan: LoadPlan, key: str) -> DataFrame:
    """The matching side: one copy of a row per shard of its key, placed like `place`."""
    _reserved(df)
    tasks = F.coalesce(F.col("_tasks"), F.array(_bin_task(plan, F.col(key))))
    return _lookup(df, plan, key).withColumn("_task", F.explode(tasks)).drop("_tasks").repartitionById(plan.slots, F.col("_task"))


def _reserved(df: DataFrame) -> None:
    if clash := {"_task", "_tasks", "_k"} & set(df.columns):
        raise ValueError(f"reserved column names in the input: {sorted(clash)}")


def balanced_counts(facts: DataFrame, key: str, identity: str, distinct: dict[str, str], match: DataFrame | None = None, match_columns: list[str] = (), slots: int | None = None, plan: LoadPlan | None = None) -> DataFrame:
    """Per key: delivered rows, distinct `identity` values, and distinct non-NULL values of each column in `distinct`.

    Result: key, `n_rows`, `n_files`, one column per entry of `distinct` (output name -> column), then `match_columns`
    of `match` (one row per key value expected; duplicates on the matching side keep the smallest values). Keys without a match get NULL
    there. NULL keys form a group of their own; rows with a NULL identity count in `n_rows` only; repeated rows count once in
    `n_files`; an empty input gives no rows; other columns, whatever their names, are not read.

    The columns asked for are placed once, row by row. Rows are merged per (key, identity, values) in their task, and per distinct value combination
    before the last, small exchange, so a key that holds a third of all rows is never in one task. `plan` is an estimate made before.
    """
    names = list(dict.fromkeys(distinct.values()))
    rows = facts.select(F.col(key).alias("key"), F.col(identity).alias("identity"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(names)])
    values = [f"v{i}" for i in range(len(names))]
    plan = plan or estimate(rows, "key", slots)
    placed = place(rows, plan, "key", ["key", "identity"])
    if match is not None:
        side = match.groupBy(F.col(key).alias("key")).agg(*[F.min(c).alias(f"m{i}") for i, c in enumerate(match_columns)])
        side = replicate(side, plan, "key").withColumnRenamed("key", "match_key").withColumnRenamed("_task", "match_task")
        condition = (F.col("_task") == F.col("match_task")) & (F.col("key") == F.col("match_key"))
    extra = [f"m{i}" for i in range(len(match_columns))]
    # The exchange below is by (_task, key, identity): `_task` already separates the shards of a large key.
    per_file = placed.groupBy("_task", "key", "identity", *values).agg(F.count(F.lit(1)).alias("n"))
    per_value = per_file.groupBy("_task", "key", *values).agg(F.sum("n").alias("n"), F.count("identity").alias("files"))
    if match is not None:
        per_value = per_value.join(side, condition, "left").drop("match_key", "match_task")
    out = per_value.groupBy("key").agg(
        F.sum("n").alias("n_rows"),
        F.sum("files").alias("n_files"),
        *[F.countDistinct(f"v{names.index(c)}").alias(name) for name, c in distinct.items()],
        *[F.min(m).alias(m) for m in extra],
    )
    return out.select(F.col("key").alias(key), "n_rows", "n_files", *distinct, *[F.col(m).alias(c) for m, c in zip(extra, match_columns)])


def heavy_keys(facts: DataFrame, key: str, identity: str, share: float, distinct: dict[str, str], slots: int | None = None) -> DataFrame:
    """Keys that hold at least `share` of all rows, repeated rows and rows without a key counted in the total; NULL is no
    key. Ties at the limit are in. The rows come from `balanced_counts`."""
    plan = estimate(facts, key, slots)
    counts = balanced_counts(facts, key, identity, distinct, plan=plan)
    return counts.filter(F.col(key).isNotNull() & (F.col("n_rows") >= F.lit(share * plan.total)))
