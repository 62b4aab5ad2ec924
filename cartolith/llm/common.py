"""Shared helpers: staged tables in the shared folder, size-checked joins, run-time bounds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side is broadcast only when its counted rows times its row width stay under this bound.
BROADCAST_BYTES = 16 << 20

#: Bytes of an Arrow batch in the pipeline, at most.
BATCH_BYTES = 8 << 20

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset on a single machine (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Paths of tables staged inside recorded() since the last drop_recorded(); None outside of it.
_recorded: list[str] | None = None
_finished: list[str] = []


@contextmanager
def recorded() -> Iterator[None]:
    """Remember the tables staged inside, so that drop_recorded() can delete them."""
    global _recorded
    _recorded = []
    try:
        yield
    finally:
        _finished.extend(_recorded)
        _recorded = None


def drop_recorded(spark: SparkSession) -> None:
    """Delete the tables staged inside recorded(); call it when the frames built on them are written."""
    while _finished:
        path = spark._jvm.org.apache.hadoop.fs.Path(_finished.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    if _recorded is not None:
        _recorded.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.staged_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def join_checked(big: DataFrame, small: DataFrame, on: list[str], how: str, row_bytes: int | Column) -> DataFrame:
    """Join with `small` broadcast if its size is under BROADCAST_BYTES, by shuffle otherwise.

    The size is the number of rows times row_bytes, or the sum of row_bytes where that is a
    column (rows of no fixed size). `small` should be a staged table: it is counted here and
    read again by the join.
    """
    if isinstance(row_bytes, Column):
        fits = (small.agg(F.sum(row_bytes)).first()[0] or 0) <= BROADCAST_BYTES
    else:
        fits = small.limit(BROADCAST_BYTES // row_bytes + 1).count() * row_bytes <= BROADCAST_BYTES
    return big.join(F.broadcast(small) if fits else small.hint("shuffle_merge"), on, how)


def bound_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of BATCH_BYTES at most: a batch is held several times by a task, in the JVM and in its worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(name).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def unused(columns: list[str], *names: str) -> list[str]:
    """The given names, each with underscores in front until no column has it (letter case aside)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def located(docs: DataFrame, name: str) -> tuple[DataFrame, list[str]]:
    """docs with two long columns that name a row for good, and the names of these columns.

    A table as it is scanned, filtered or projected is told by file and row number, and not copied; any
    other frame is staged first. A frame that repeats rows of a scan (a join) must be staged by the caller.
    """
    file, row = unused(docs.columns, "__file", "__at")
    place = lambda df: df.select("*", F.xxhash64(df.metadataColumn("_metadata")["file_path"]).alias(file), df.metadataColumn("_metadata")["row_index"].alias(row))
    try:
        found = place(docs)
        found.schema  # resolved here: frames that are no scan have no such column
    except AnalysisException:
        found = place(staged(docs, name))
    return found, [file, row]


def ascii_lower(col):
    """Lower-case A-Z only. A pure ASCII value takes the fast built-in path."""
    plain = F.octet_length(col) == F.length(col)
    return F.when(plain, F.lower(col)).otherwise(F.translate(col, ASCII_UPPER, ASCII_UPPER.lower()))
