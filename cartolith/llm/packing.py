"""Concatenate-and-cut packing of tokenised documents into fixed windows.

Pass one tokenises every document and keeps the ids, together with the
partition, the row number there and the number of tokens before it in that
partition. The token totals of the partitions (one row per task) are summed in
order, which gives each partition its global offset. Pass two cuts every
document at multiples of the window; a document that crosses a window's edge
gives one piece on each side, so nothing is shuffled but the totals.

Defined results: null and empty texts give one token (the end id); repeated
rows are packed once each; extra columns are ignored; an empty table gives an
empty result. All windows are full but the last, which is padded to the next
power of two.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartolith.llm.common import join_checked, staged

SEQUENCE = 2048
END_ID = 1


#: Texts without these characters and without control strings take the faster engine; all others are given to the tokenizer itself.
UNUSUAL = "[^\t\n\r\x20-\x7e\u00c0-\u024f]"


class TextIds:
    """Ids of texts as little-endian uint16 bytes.

    The tokenizer's vocabulary and merges, in which a merge's rank is its id, also drive
    a faster engine of the same algorithm; it takes the texts whose characters
    both classify alike.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit into 16 bits")
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        letters = [b for b in range(256) if chr(b) in ByteLevel.alphabet()]
        others = [b for b in range(256) if b not in letters]
        byte = {chr(b): b for b in letters} | {chr(256 + k): b for k, b in enumerate(others)}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.unusual = re.compile("|".join([UNUSUAL, *map(re.escape, special)]))
        ranks = {bytes(byte[c] for c in piece): k for piece, k in self.tokenizer.get_vocab().items() if piece not in special}
        self.engine = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.unusual.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()
        return np.array(self.engine.encode_ordinary(text), dtype="<u2").tobytes()


@lru_cache(maxsize=1)
def text_ids(path: str, pattern: str) -> TextIds:
    """One instance per worker process."""
    return TextIds(path, pattern)


def tokenised(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, part, row, before, n, ids): ids as uint16 bytes with the end id; before = tokens before it in the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core only
        ids = text_ids(public_tokenizers.path(vocabulary), public_tokenizers.PATTERN)
        end = np.array([END_ID], dtype="<u2").tobytes()
        part, row, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                data = [ids.encode(t or "") + end for t in batch.column(1)[at : at + 256].to_pylist()]
                n = np.array([len(d) // 2 for d in data], dtype=np.int64)
                starts = before + np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[at : at + 256], pa.array([part] * len(n), pa.int32()), pa.array(np.arange(row, row + len(n))), pa.array(starts), pa.array(n), pa.array(data, pa.binary())],
                    ["doc_id", "part", "row", "before", "n", "ids"],
                )
                row, before = row + len(n), before + int(n.sum())

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, part int, row long, before long, n long, ids binary")


def offsets(tokens: DataFrame) -> DataFrame:
    """(part, base, total): exclusive prefix sums of the partitions' token totals; one row per task of pass one."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("tokens"))
    order = Window.orderBy("part")
    return totals.select("part", (F.sum("tokens").over(order) - F.col("tokens")).alias("base"), F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))


def cut(tokens: DataFrame, bases: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """One row per piece; a piece is a document's tokens inside one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length", "boundary"]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out: list[tuple] = []
                columns = [batch.column(k)[at : at + 512].to_pylist() for k in range(5)]
                for doc, first, n, ids, total in zip(*columns, strict=True):
                    values = np.frombuffer(ids, dtype="<u2").astype("<u4")
                    start = 0
                    while start < n:
                        sequence, offset = divmod(first + start, size)
                        length = min(n - start, size - offset)
                        used = min(size, total - sequence * size)
                        padded = size if used == size else 1 << (used - 1).bit_length()
                        out.append((doc, start, length, zlib.crc32(values[start : start + length].tobytes()), n, sequence, offset, padded, length < n))
                        start += length
                if out:
                    arrays = [pa.array(c, pa.int64()) for c in list(zip(*out, strict=True))[:8]] + [pa.array([o[8] for o in out], pa.bool_())]
                    yield pa.RecordBatch.from_arrays(arrays, names)

    placed = join_checked(tokens, bases, ["part"], "inner", 32).select("doc_id", (F.col("base") + F.col("before")).alias("first"), "n", "ids", "total")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long, boundary boolean"
    return placed.mapInArrow(run, schema)


def packed(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", size: int = SEQUENCE) -> DataFrame:
    """Pack all documents into sequences of `size` tokens; one row per piece."""
    tokens = staged(tokenised(docs, vocabulary), "tokens")
    return cut(tokens, staged(offsets(tokens), "token-offsets"), size)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pack_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of all documents that stay."""
    return packed(docs)


QUERIES = {"op5_packing": op5_packing}
SQL: dict[str, str] = {}
