"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into two halves of two 16-bit segments. If two
fingerprints differ in at most three bits, one half differs in at most one
bit, so one of its segments is equal and the other differs in at most one bit.
That other segment is read as a word of the perfect (23, 12) Golay code: every
word lies within three bits of exactly one code word. A word also gets the code
words at distance four as keys, so a word one bit away finds the nearest code
word of its partner among its own keys. Key = half, segment, the equal segment,
code word index; candidates are then verified by their bit count.

Defined results: null and empty texts have fingerprint zero and link like any
other; repeated rows share their fingerprint, hence their component; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm import linking
from cartolith.llm.common import join_checked, staged, unused

GOLAY = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
SEED = 42


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of the word shingles of a text: a bit is set when over half of the shingle hashes set it."""
    words = text.lower().split()  # bytes: A-Z and the six ASCII white-space bytes only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    span = min(width, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - span + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[span - 1 :].tolist(), strict=True)), dtype=np.uint64, count=len(starts))
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) for every row, whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = [fingerprint(t.as_py() or b"", width) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def remainder(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial."""
    out = words.copy()
    for bit in range(22, 10, -1):
        out ^= np.where(out >> bit & 1, GOLAY << (bit - 11), 0)
    return out


@lru_cache(1)
def golay_keys() -> tuple[np.ndarray, np.ndarray]:
    """For every 16-bit segment, padded to 23 bits: six code word indices, and how many of them hold (1 or 6).

    Index 0 is the nearest code word; with three errors the five code words at distance four follow.
    """
    messages = np.arange(4096) << 11
    code = messages ^ remainder(messages)
    sevens = code[np.bitwise_count(code.astype(np.uint32)) == 7]
    errors = np.zeros(2048, dtype=np.int64)
    further = np.zeros((2048, 5), dtype=np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            error = sum(1 << b for b in bits)
            at = remainder(np.array([error]))[0]
            errors[at] = error
            if weight == 3:
                further[at] = sevens[(sevens & error) == error]
    words = np.arange(1 << 16) << 7
    syndrome = remainder(words)
    nearest = words ^ errors[syndrome]
    keys = np.concatenate([nearest[:, None], nearest[:, None] ^ further[syndrome]], axis=1) >> 11
    return keys.astype(np.int32), np.where(np.bitwise_count(errors[syndrome].astype(np.uint32)) == 3, 6, 1)


def fuzzy_keys(nodes: DataFrame) -> DataFrame:
    """(key, fp, main) rows: four equal-segment choices times one or six code words; main marks the nearest one."""
    tables = nodes.sparkSession.sparkContext.broadcast(golay_keys())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held = tables.value
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 20000):
                fp = fps[at : at + 20000]
                segments = [(fp.view(np.uint64) >> np.uint64(16 * k)).astype(np.int64) & 0xFFFF for k in range(4)]
                for choice, (equal, fuzzy) in enumerate(((0, 1), (1, 0), (2, 3), (3, 2))):
                    words = keys[segments[fuzzy]]
                    used = np.arange(6)[None, :] < held[segments[fuzzy]][:, None]
                    key = (choice << 28) | (segments[equal][:, None] << 12) | words
                    main = np.broadcast_to(np.arange(6)[None, :] == 0, used.shape)
                    copies = np.broadcast_to(fp[:, None], used.shape)
                    yield pa.RecordBatch.from_arrays([pa.array(key[used]), pa.array(copies[used]), pa.array(main[used])], ["key", "fp", "main"])

    return nodes.select("fp").mapInArrow(run, "key long, fp long, main boolean")


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): components of fingerprints at max_bits (3 at most) or fewer differing bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the keys guarantee links up to three differing bits")
    marked = staged(fingerprints(docs, width), "simhash")
    nodes = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    small, large = linking.live_rows(fuzzy_keys(nodes), "simhash")
    links = staged(linking.small_pairs(small, max_bits).unionByName(linking.large_pairs(large, max_bits)).distinct(), "simhash-links")
    named = links.join(nodes.select(F.col("fp").alias("a"), F.col("node").alias("na")), "a").join(nodes.select(F.col("fp").alias("b"), F.col("node").alias("nb")), "b")
    found = linking.components(named.select(F.col("na").alias("a"), F.col("nb").alias("b")), "simhash-cc")
    classes = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return marked.join(staged(classes, "simhash-classes"), "fp")


def keep_one(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the row with the smallest doc_id stays (the first row of it, where rows repeat).

    Null and empty texts have fingerprint zero and are one component; a null document id sorts first; extra columns
    stay as they are; an empty table stays empty.
    """
    (row,) = unused([*docs.columns, "component_id"], "__row")
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), "simhash-rows")
    found = near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    named = numbered.select(row, "doc_id").join(found, row)
    first = named.groupBy("component_id").agg(F.min(F.struct("doc_id", row)).alias("first")).select(F.col("first")[row].alias(row))
    return join_checked(numbered, staged(first, "simhash-kept"), [row], "left_semi", 16).drop(row)


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash": op7_simhash}
SQL: dict[str, str] = {}
