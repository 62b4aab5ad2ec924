"""Exact deduplication over a stream with keyed state that never expires.

The documents arrive as a file stream. Per digest of the normalised text the
state (RocksDB, on disk, checkpointed in the shared folder) retains the
largest document id, the number of rows and the content locator (file key and
row number) of the retained row; there is no watermark, so nothing expires.
Digest hits are then checked on the full bytes: each row of a group is
compared with the text found at the retained locator. Rows that share a digest
without sharing the text are regrouped by the text itself.

Defined results: null texts are empty texts; of repeated rows (same doc_id and
text) all count, and all with the kept doc_id stay; a null doc_id never stays while another
id is in its group; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm.common import ascii_lower, fresh_path, join_checked, staged

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
#: Rows of one group that are compared with one copy of its retained text.
SALT_ROWS = 256


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def keyed(docs: DataFrame, digest=sha256) -> DataFrame:
    """(doc_id, text, digest, file_key, file_row): normalised text, its digest and its locator."""
    text = ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    located = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64("_metadata.file_path").alias("file_key"), F.col("_metadata.row_index").alias("file_row"))
    return located.withColumn("digest", digest(F.col("text")))


def stream_state(spark: SparkSession, path: str, checkpoint: str, digest=sha256) -> DataFrame:
    """Feed what is new at `path` into the state kept at `checkpoint` and return the state.

    (digest, doc_id, n, file_key, file_row); a later call with the same checkpoint reads new files only.
    """
    before = {key: spark.conf.get(key, None) for key in STATE_CONF}
    for key, value in STATE_CONF.items():
        spark.conf.set(key, value)
    try:
        schema = spark.read.parquet(path).schema
        # as a pattern, `path` may be one file as well as a folder
        rows = keyed(spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]"), digest)
        groups = rows.groupBy("digest").agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("n"), F.max_by("file_key", "doc_id").alias("file_key"), F.max_by("file_row", "doc_id").alias("file_row"))
        query = groups.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    # the value holds the aggregation buffers in order; max_by keeps the ordering beside its value
    value = F.col("value").cast("struct<doc_id:long,n:long,file_key:long,k1:long,file_row:long,k2:long>")
    rows = spark.read.format("statestore").load(checkpoint).select("key.digest", value.alias("v"))
    return rows.select("digest", "v.doc_id", "v.n", "v.file_key", "v.file_row")


def exact_duplicates(spark: SparkSession, path: str, checkpoint: str | None = None, digest=sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) for every row of the Parquet table at `path`."""
    state = stream_state(spark, path, checkpoint or fresh_path(spark, "exact-state"), digest)
    groups = state.where("n > 1").select("digest", F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"), F.col("file_key").alias("keep_file"), F.col("file_row").alias("keep_row"))
    groups = staged(groups, "exact-groups")
    docs = keyed(spark.read.parquet(path), digest)

    # full bytes: each hit against the text at the retained locator, dealt by salts so that no group meets in one task
    hits = staged(join_checked(docs, groups, ["digest"], "inner", 72), "exact-hits")
    salts = F.ceil(F.col("group_size") / F.lit(SALT_ROWS)).cast("int")
    retained = hits.where("file_key = keep_file AND file_row = keep_row").select("digest", F.col("text").alias("kept_text"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    salted = hits.withColumn("salt", F.pmod(F.xxhash64("file_key", "file_row"), salts).cast("int"))
    differing = salted.join(retained, ["digest", "salt"]).where("text <> kept_text").select("digest", "file_key", "file_row", "doc_id", "text")
    differing = staged(differing, "exact-differing")
    sizes = groups.select("digest", "keep_id", "group_size")
    if not differing.isEmpty():
        return _regrouped(docs, sizes, differing)
    out = join_checked(docs.drop("text"), sizes, ["digest"], "left", 56)
    return _marked(out)


def _marked(rows: DataFrame) -> DataFrame:
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    return rows.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), (keep.isNull() | keep.eqNullSafe(F.col("doc_id"))).alias("kept"), "digest")


def _regrouped(docs: DataFrame, sizes: DataFrame, differing: DataFrame) -> DataFrame:
    """The result when different texts share a digest: those that differ from the retained text form groups by text."""
    place = ["digest", "file_key", "file_row"]
    by_text = differing.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    apart = _marked(differing.join(by_text, ["digest", "text"]))
    lost = differing.groupBy("digest").agg(F.count("*").alias("lost"))
    rest = docs.drop("text").join(differing.select(place), place, "left_anti")
    sizes = sizes.join(lost, "digest", "left").select("digest", "keep_id", (F.col("group_size") - F.coalesce("lost", F.lit(0))).alias("group_size"))
    return _marked(rest.join(sizes, "digest", "left")).unionByName(apart)


def op2_exact(spark, sf_dir: str) -> DataFrame:
    found = exact_duplicates(spark, f"{sf_dir}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


QUERIES = {"op2_exact": op2_exact}
SQL = {
    "op2_exact": """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
}
