"""Session helpers used by the bench, the tests and applications."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the library is written for (UTC, AQE on, last map key wins)."""
    builder = (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep spark.checkpoint.dir where it is set; otherwise (tests, one machine) use a temporary folder."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp(prefix="spark-"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder as Parquet and read back: a checkpoint that is compressed."""
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Largest table, by its size estimate, that Spark may broadcast unasked.
UNASKED = 256 << 10


def bound_broadcasts(spark: SparkSession) -> None:
    """Keep Spark from broadcasting tables that grow: sizes are those of compressed bytes, of which runs of ids need few.

    Ten megabytes (the default) of such a shuffle are some hundred megabytes of rows in the driver. Hints are not concerned.
    """
    name = "spark.sql.autoBroadcastJoinThreshold"
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", spark.conf.get(name).strip().lower()).groups()
    if int(number) << 10 * (" kmgtp".index(unit or " ")) > UNASKED:
        spark.conf.set(name, str(UNASKED))


def bound_disk(spark: SparkSession) -> None:
    """Delete a query's shuffle files when it ends: otherwise they stay until the driver happens to collect its garbage."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


#: Bytes of tables for which there is a shuffle partition of its own, and of a shuffle that one task reads.
SHARE, READ = 2 << 20, 4 << 20


def bound_tasks(spark: SparkSession, sf_dir: str) -> None:
    """Let the number of tasks after a shuffle grow with the tables, so that a task's share does not; adaptive execution joins small ones."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARE)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(parts))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(READ))
