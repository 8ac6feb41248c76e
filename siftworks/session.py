"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "siftworks", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine assumes (UTC, AQE, Arrow); `conf` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        # Checkpoint files go with the frames that were cut.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends the package's modules to the executors, once per application: Python workers import them wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_siftworks_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="siftworks-package-")) / "siftworks-package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for module in sorted(root.rglob("*.py")):
            z.write(module, module.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._siftworks_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names. Only a local master may do without one: on a cluster a temporary folder is each machine's own."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    target = spark.conf.get("spark.checkpoint.dir", None)
    if not target:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        target = tempfile.mkdtemp(prefix="siftworks-checkpoint-")
    spark.sparkContext.setCheckpointDir(target)
    return target


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` on the shared checkpoint folder and cut its lineage; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def task_slots(spark: SparkSession) -> int:
    """Tasks to aim for in one wave: the shuffle partition setting, which a deployment sizes to its cluster and data."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: Rows up to which a lookup table is broadcast; a larger one is joined like any other.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A lookup table with a broadcast hint if it has at most `most` rows, which is counted; without one beyond that."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(scan: DataFrame) -> DataFrame:
    """A table scan before row-wise Python work: with fewer partitions than cores its rows are dealt out, else it stays as it is.

    Only small or badly split inputs move (one Parquet row group can't be split by a reader setting); a large table has more splits than there are cores."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
