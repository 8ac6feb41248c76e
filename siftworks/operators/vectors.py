"""Exact vector search in blocks: rows are packed into blocks of bounded size, pairs of blocks are scored by one matrix product each.

The number of joined rows is that of block pairs, not of vector pairs; a task holds two blocks and their scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2048


def packed(vectors: DataFrame, size: int = BLOCK) -> DataFrame:
    """(group, block, ids, vectors) of rows (id, vector, group), about `size` distinct ids per block and no block with two groups. NULL vectors are left out; NULL is a
    group like any other."""
    rows = vectors.filter(F.col("vector").isNotNull()).select("id", "vector", "group").dropDuplicates(["id"])
    sizes = rows.groupBy(F.col("group").alias("_g")).agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).alias("_n"))
    placed = rows.join(sizes, F.col("group").eqNullSafe(F.col("_g"))).withColumn("block", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    return placed.groupBy("group", "block").agg(F.collect_list(F.struct("id", "vector")).alias("r")).select("group", "block", F.col("r.id").alias("ids"), F.col("r.vector").alias("vectors"))


def _sides(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    left, right = (df.select(*[F.col(c).alias(f"{c}_{x}") for c in df.columns]) for df, x in ((a, "a"), (b, "b")))
    return left, right


def _matrix(vectors: pa.ListScalar) -> np.ndarray:
    """The vectors of a block as one matrix, straight from the Arrow buffers."""
    rows = vectors.values
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(rows), -1)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[dict, np.ndarray]]:
    """The row of each pair of blocks, and their scores."""
    for k in range(batch.num_rows):
        r = {name: batch.column(name)[k] for name in batch.schema.names}
        yield r, _matrix(r["vectors_a"]) @ _matrix(r["vectors_b"]).T


def pairs_above(vectors: DataFrame, least: float, size: int = BLOCK) -> DataFrame:
    """(id_a, id_b, score): pairs of one group, id_a < id_b, whose dot product is at least `least`. An empty input gives no rows."""
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, scores in _blocks(batch):
                i, j = np.nonzero(scores >= least)
                a, b = r["ids_a"].values.take(pa.array(i)), r["ids_b"].values.take(pa.array(j))
                keep = pc.less(a, b) if r["block_a"].as_py() == r["block_b"].as_py() else pc.not_equal(a, b)
                out = pa.RecordBatch.from_arrays([pc.min_element_wise(a, b), pc.max_element_wise(a, b), pa.array(scores[i, j])], names=["id_a", "id_b", "score"])
                yield out.filter(keep)

    # Only blocks of one group meet, each pair once, in a task of its own.
    left, right = _sides(*[packed(vectors, size)] * 2)
    met = left.join(right, F.col("group_a").eqNullSafe(F.col("group_b")) & (F.col("block_a") <= F.col("block_b")))
    return met.repartition(F.col("group_a"), F.col("block_a"), F.col("block_b")).mapInArrow(run, f"id_a {kind}, id_b {kind}, score double")


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 1, size: int = BLOCK) -> DataFrame:
    """(query_id, id, score, place): the k best rows for each query by dot product, a row never being its own neighbour; ties go to the smaller id. Both sides are (id, vector)."""
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, scores in _blocks(batch):
                asked, ids = r["ids_a"].values, r["ids_b"].values
                # Columns in order of ids, so that a stable sort lets the smaller id win ties.
                order = pc.sort_indices(ids).to_numpy()
                ids, scores = ids.take(pa.array(order)), scores[:, order]
                top = np.argsort(-scores, axis=1, kind="stable")[:, : k + 1]
                q = np.repeat(np.arange(len(asked)), top.shape[1])
                found = pa.RecordBatch.from_arrays([asked.take(pa.array(q)), ids.take(pa.array(top.ravel())), pa.array(np.take_along_axis(scores, top, axis=1).ravel())], names=["query_id", "id", "score"])
                yield found.filter(pc.not_equal(found.column(0), found.column(1)))

    none = F.lit(None).cast("int").alias("group")
    q, v = (packed(df.select("id", "vector", none), size) for df in (queries, vectors))
    # A stated query set against all rows: every block of one side with every block of the other.
    left, right = _sides(q, v)
    local = left.join(right, F.col("group_a").eqNullSafe(F.col("group_b"))).repartition(F.col("block_a"), F.col("block_b")).mapInArrow(run, f"query_id {kind}, id {kind}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return local.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
