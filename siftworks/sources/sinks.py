"""Writers: whole replacement, append-only logs, resumable batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: File that names the folder of a table's current version.
POINTER = "_current"


def _pointed(spark: SparkSession, path: str) -> str | None:
    """The version that the pointer at `path` names; None where there is no pointer."""
    jvm, target, fs = _fs(spark, f"{path}/{POINTER}")
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def current_table(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table written by `replace_table`; a plain Parquet folder is read as it is."""
    version = _pointed(spark, path)
    return spark.read.parquet(f"{path}/{version}" if version else path)


def previous_table(spark: SparkSession, path: str) -> DataFrame:
    """The version before the current one, kept by `replace_table(..., backup=True)`."""
    return spark.read.parquet(f"{path}/{_pointed(spark, path)}.bak")


def replace_table(df: DataFrame, path: str, backup: bool = False) -> None:
    """Write a new version in a folder of its own, then turn the pointer: one atomic rename over the old pointer file, so that readers see the old table or the new one
    and a failure before it changes nothing. The frame may read the table. Older versions are removed after the turn, the last one only where `backup` isn't
    asked for; readers that still work on it are to be let finish or to read again."""
    spark = df.sparkSession
    jvm, base, fs = _fs(spark, path)
    old, fresh = _pointed(spark, path), f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{fresh}")
    hadoop = jvm.org.apache.hadoop.fs
    tmp, pointer = hadoop.Path(f"{path}/{POINTER}.{fresh}"), hadoop.Path(f"{path}/{POINTER}")
    out = fs.create(tmp, True)
    out.write(bytearray(fresh.encode()))
    out.hsync()
    out.close()
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    over[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    context.rename(fs.makeQualified(tmp), fs.makeQualified(pointer), over)
    kept = {fresh, POINTER}
    if backup and old:
        if not fs.rename(hadoop.Path(f"{path}/{old}"), hadoop.Path(f"{path}/{fresh}.bak")):
            raise OSError(f"the version before {fresh} couldn't be kept as its backup")
        kept.add(f"{fresh}.bak")
    for status in fs.listStatus(base):
        if status.getPath().getName() not in kept:
            fs.delete(status.getPath(), True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file with a text, in whatever file system the path names; its folder is made, a file there replaced."""
    _, target, fs = _fs(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def stamped(df: DataFrame, column: str = "ts") -> DataFrame:
    """Rows with the time of their writing, UTC."""
    return df.withColumn(column, F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def append_log(df: DataFrame, path: str) -> None:
    """Append JSON lines with a UTC time `ts`."""
    stamped(df).write.mode("append").json(path)


def write_report(df: DataFrame, path: str, form: str = "json") -> None:
    """A result as a report folder: `json` lines, or `text` lines `first: second, third`, ordered by the first column. NULL is written as `-`."""
    ordered = df.orderBy(df.columns[0])
    if form == "json":
        ordered.write.mode("overwrite").json(path)
    elif form == "text":
        shown = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in df.columns]
        ordered.select(F.concat_ws(": ", shown[0], F.concat_ws(", ", *shown[1:])).alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"report form {form!r}")


def resume(work: DataFrame, path: str, key: str, step: Callable[[DataFrame], DataFrame]) -> int:
    """Run `step` on the work whose key isn't in the checkpoint table at `path` and append the results; the number of keys that were open. A second run finds nothing open."""
    spark = work.sparkSession
    _, target, fs = _fs(spark, path)
    open_work = work.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti") if fs.exists(target) else work
    n = open_work.select(key).distinct().count()
    if n:
        step(open_work).write.mode("append").parquet(path)
    return n
