"""Streaming counterparts: counts, windows, upserts, keyed state with expiry, quotas, log classification."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from siftworks.functions.text import error_category, is_restricted
from siftworks.operators.ingest import upsert


def file_stream(spark: SparkSession, folder: str, glob: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """A stream over the Parquet files of a folder; timestamps without zone become UTC timestamps, which watermarks need."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    df = reader.parquet(folder)
    return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])


def window_counts(events: DataFrame, every: str = "1 day", late: str | None = "1 hour", slide: str | None = None) -> DataFrame:
    """(window_start, event_type, n, total) per tumbling or sliding window. Works on batches and, with a watermark, on streams."""
    timed = events.withWatermark("ts", late) if events.isStreaming and late else events
    w = F.window("ts", every, slide) if slide else F.window("ts", every)
    return timed.groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    """(user_id, session_start, session_end, n) of sessions that end with a gap."""
    timed = events.withWatermark("ts", late) if events.isStreaming and late else events
    return timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def running_counters(results: DataFrame) -> DataFrame:
    """Indexed items, errors and the last error; use output mode `complete` on a stream."""
    bad = F.col("event_type") == "error"
    return results.groupBy().agg(F.count_if(~bad).alias("indexed"), F.count_if(bad).alias("errors"), F.max(F.when(bad, F.col("ts"))).alias("last_error"))


def daily_quota(events: DataFrame, limit: int = 20, exempt: list[int] = ()) -> DataFrame:
    """(user_id, usage_date, used, rejected, resets_at): uses per user and UTC day, those beyond the limit rejected; exempt users never."""
    day = F.to_date("ts")
    used = events.groupBy("user_id", day.alias("usage_date")).agg(F.count(F.lit(1)).alias("used"))
    over = F.greatest(F.col("used") - limit, F.lit(0))
    return used.select("user_id", "usage_date", "used", F.when(F.col("user_id").isin(list(exempt)), 0).otherwise(over).cast("long").alias("rejected"), (F.col("usage_date") + F.expr("interval 1 day")).cast("timestamp").alias("resets_at"))


#: Column that lays a merged table out in folders.
BUCKET = "_bucket"


def merge_into(path: str, keys: list[str], columns: list[str], buckets: int = 64):
    """A foreachBatch function that merges each micro-batch into a Parquet table; batches sent again change nothing.

    The table lies in folders by a hash of the keys. Only folders that hold keys of the batch are read and replaced, so the work follows the batch and not the table once
    there are more folders than a batch has keys in; `buckets` is fixed for a table's life. Readers drop `_bucket`."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        fresh = batch.withColumn(BUCKET, bucket)
        # At most `buckets` numbers.
        touched = sorted(r[0] for r in fresh.select(BUCKET).distinct().collect())
        try:
            old = spark.read.parquet(path).filter(F.col(BUCKET).isin(touched)).drop(BUCKET)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = batch.limit(0)
        merged = upsert(old, batch, keys, columns).withColumn(BUCKET, bucket)
        merged.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)

    return run


def cycle(spark: SparkSession, work: Callable[[int], None], every: str, checkpoint: str | None = None) -> StreamingQuery:
    """Runs `work(n)` every so often, one run at a time: a trigger that falls into a run is skipped, and the next run starts at the next multiple of the interval.
    Micro-batches of a stream never overlap, so a stream of ticks is the clock; the query it gives is stopped like any other."""
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    writer = ticks.writeStream.trigger(processingTime=every).foreachBatch(lambda _, n: work(n))
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def classified_errors(lines: DataFrame) -> DataFrame:
    """(dataset, message, category) of failure lines of a log stream, the first per data set where duplicates are dropped by the caller."""
    fail = r"\[(?:FAIL|crawler)\]\s+(?:Error indexing\s+)?(ds\w+)(?:\s+\||:)\s+(.+?)(?:\s+\|\s+indexed=.*)?$"
    found = lines.select(F.regexp_extract("value", fail, 1).alias("dataset"), F.regexp_extract("value", fail, 2).alias("message")).filter("dataset <> ''")
    return found.filter(~is_restricted(F.col("message"))).withColumn("category", error_category(F.col("message")))


def _expiring_count(ttl_ms: int) -> StatefulProcessor:
    """Uses per key within a time to live: the count starts again when the state expires. A local class travels with its code: the
    driver-side worker of a stateful stream doesn't see shipped modules."""

    class ExpiringCount(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.count = handle.getValueState("count", StructType([StructField("n", LongType())]), ttlDurationMs=ttl_ms)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
            n = self.count.get()[0] if self.count.exists() else 0
            for pdf in rows:
                n += len(pdf)
            self.count.update((n,))
            yield pd.DataFrame({"user_id": [key[0]], "used": [n]})

        def close(self) -> None:
            pass

    return ExpiringCount()


def expiring_counts(events: DataFrame, ttl_ms: int = 1_800_000) -> DataFrame:
    """(user_id, used) per micro-batch, by keyed state that expires. Needs the RocksDB state store."""
    return events.groupBy("user_id").transformWithStateInPandas(statefulProcessor=_expiring_count(ttl_ms), outputStructType="user_id long, used long", outputMode="Update", timeMode="ProcessingTime")
