"""Codes of vectors by product quantisation, with exact integer distances in the Walsh-Hadamard domain.

Components become whole numbers, floor(scale x). A vector is cut into equal consecutive parts; each part
position has a codebook, and a part's code is the index of its codebook's nearest entry. Codebooks start as the
parts of the vectors with the smallest ids and are moved to the floors of their parts' means for some rounds.

Nearest entries: parts and entries are padded with zeros to a power of two P and transformed by the integer
Walsh-Hadamard transform, which multiplies squared distances by P. Its coefficients are taken in order of
sequency (sign changes), which puts the smooth, heavy ones first. Squared differences are summed coefficient
by coefficient; an entry whose sum so far exceeds the full sum of another entry can't be nearest any more and
is left out early. Sums are whole numbers, so the result is exact; equal ones go to the lower index.

A task assigns its rows and adds up their parts per entry, so a round shuffles as many rows per task as there
are entries and positions, split into 32-bit limbs that can't overflow. Only the codebooks, whose size is fixed
(ENTRIES times the dimension), reach the driver. Every round reads the table again; nothing is kept.

Defined results: rows whose vector is null or holds null or non-finite components are dropped; of vectors of
different lengths the shorter ones are continued by zeros, up to the longest length rounded up to a multiple
of the parts; repeated rows count each; null ids and labels stay (null ids seed a codebook last, equal ids in
the order of their vectors); with fewer rows than ENTRIES the codebooks are shorter; an empty table gives an
empty result. Whole numbers too large for sums of 64 bits (2^26 in parts of 16 components) are computed without
a bound on their size; a squared distance or sum that no long can hold is null. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm.common import staged

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Coefficients summed for all entries at first; the number doubles with every look at those that are left.
FIRST = 4
BLOCK = 512
LIMB = 32
LONG = (1 << 63) - 1


def padded(width: int) -> int:
    return 1 << max(0, (width - 1).bit_length())


def safe(width: int) -> int:
    """Whole numbers below this keep the scaled squared distance of two parts inside 64 bits."""
    return (1 << 30) // padded(width)


def sequency_order(size: int) -> np.ndarray:
    """Natural (Hadamard) place of every coefficient, by rising number of sign changes: the bit-reversed Gray code."""
    bits = size.bit_length() - 1
    gray = [s ^ (s >> 1) for s in range(size)]
    return np.array([int(f"{g:0{bits}b}"[::-1], 2) if bits else 0 for g in gray])


def transformed(parts: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of rows, padded with zeros to a power of two, in order of sequency."""
    n, width = parts.shape
    size = padded(width)
    out = np.zeros((n, size), dtype=parts.dtype)
    out[:, :width] = parts
    half = 1
    while half < size:
        pairs = out.reshape(n, size // (2 * half), 2, half)
        out = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(n, size)
        half *= 2
    return out[:, sequency_order(size)]


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of, and squared distance to, the nearest entry of transformed rows and entries; the lower index of equal ones."""
    codes, errors = np.empty(len(rows), dtype=np.int64), np.empty(len(rows), dtype=rows.dtype)
    size = rows.shape[1]
    for at in range(0, len(rows), BLOCK):
        own = rows[at : at + BLOCK]
        sums = np.zeros((len(own), len(entries)), dtype=rows.dtype)
        for k in range(min(FIRST, size)):
            apart = own[:, k, None] - entries[None, :, k]
            sums += apart * apart
        # the entry ahead is summed to the end: no nearest entry can exceed it
        ahead = sums.argmin(axis=1)
        bound = ((own - entries[ahead]) ** 2).sum(axis=1)
        row, entry = np.nonzero(sums <= bound[:, None])
        left, k, step = sums[row, entry], FIRST, FIRST
        while k < size:
            left = left + ((own[row, k : k + step] - entries[entry, k : k + step]) ** 2).sum(axis=1)
            stay = left <= bound[row]
            row, entry, left = row[stay], entry[stay], left[stay]
            k, step = k + step, 2 * step
        first = np.flatnonzero(np.diff(row, prepend=-1))  # every row keeps the entry ahead at least
        least = np.minimum.reduceat(left, first)
        best = np.flatnonzero(left == np.repeat(least, np.diff(first, append=len(row))))
        best = best[np.flatnonzero(np.diff(row[best], prepend=-1))]
        codes[at : at + BLOCK], errors[at : at + BLOCK] = entry[best], left[best] // size
    return codes, errors


def whole_numbers(vectors: pa.Array, dims: int, width: int, scale: int) -> np.ndarray:
    """floor(scale x) of every component, with zeros after the end of shorter vectors; Python numbers where 64 bits are not safe."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.asarray(vectors.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    kind = np.int64 if not len(flat) or np.abs(flat).max() < safe(width) // scale else object
    out = np.zeros((len(lengths), dims), dtype=kind)
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, place] = np.floor(scale * flat).astype(np.int64) if kind is np.int64 else np.array([scale * int(v) if abs(v) > 1 << 52 else math.floor(scale * v) for v in flat.tolist()], dtype=object)
    return out


class Codebooks:
    """The entries of all part positions, and their transforms."""

    def __init__(self, entries: list[list[list[int]]]):
        self.width = len(entries[0][0])
        wide = max(abs(v) for book in entries for e in book for v in e) >= safe(self.width)
        self.books = [np.array(book, dtype=object if wide else np.int64) for book in entries]
        self.turned = [transformed(book) for book in self.books]

    def codes(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and squared distances of every part: two arrays (rows, parts)."""
        width, found = self.width, []
        for k, turned in enumerate(self.turned):
            own = transformed(numbers[:, k * width : (k + 1) * width])
            if own.dtype != turned.dtype:
                own, turned = own.astype(object), turned.astype(object)
            found.append(nearest(own, turned))
        return np.stack([c for c, _ in found], axis=1), np.stack([e for _, e in found], axis=1)

    def sha256(self) -> str:
        """Digest of all components by part, entry and position, as decimal numbers with commas between."""
        return hashlib.sha256(",".join(str(v) for book in self.books for e in book.tolist() for v in e).encode()).hexdigest()


def kept(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows whose vector is whole and finite."""
    v = F.col("embedding").cast("array<double>")
    infinite = F.lit(float("inf"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == infinite))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("embedding")).where(v.isNotNull() & ~bad)


def entry_sums(rows: DataFrame, books: Codebooks, dims: int, scale: int, limbs: int) -> list[tuple]:
    """(part, entry, position, number of rows, limbs of the sum): one row per part, entry and position, a number fixed by the codebooks' size."""
    width = books.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = [len(b) for b in books.books]
        counts = [np.zeros(n, dtype=np.int64) for n in size]
        sums: list[np.ndarray] = [np.zeros((n, width), dtype=object) for n in size]
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                numbers = whole_numbers(batch.column(0)[at : at + 8192], dims, width, scale)
                codes, _ = books.codes(numbers)
                for k, n in enumerate(size):
                    counts[k] += np.bincount(codes[:, k], minlength=n)
                    own = np.zeros((n, width), dtype=numbers.dtype)
                    np.add.at(own, codes[:, k], numbers[:, k * width : (k + 1) * width])
                    sums[k] = sums[k] + own.astype(object)
        out = []
        for k, n in enumerate(size):
            for e in np.flatnonzero(counts[k]).tolist():
                for place, total in enumerate(sums[k][e].tolist()):
                    digits = [(total >> (LIMB * i)) & ((1 << LIMB) - 1) for i in range(limbs - 1)] + [total >> (LIMB * (limbs - 1))]
                    out.append((k, e, place, int(counts[k][e]), digits))
        if out:
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(columns[4], pa.list_(pa.int64()))], ["part", "entry", "place", "n", "limbs"])

    partial = rows.select("embedding").mapInArrow(run, "part long, entry long, place long, n long, limbs array<long>")
    return partial.groupBy("part", "entry", "place").agg(F.sum("n"), *[F.sum(F.col("limbs")[i]) for i in range(limbs)]).collect()


def moved(entries: list[list[list[int]]], sums: list[tuple]) -> list[list[list[int]]]:
    """Entries at the floors of their parts' means; unused ones stay."""
    out = [[list(e) for e in book] for book in entries]
    for part, entry, place, n, *limbs in sums:
        out[part][entry][place] = sum(v << (LIMB * i) for i, v in enumerate(limbs)) // n
    return out


def trained(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[Codebooks | None, int]:
    """Codebooks of the kept rows after all rounds, and the (padded) dimension; None without rows.

    The first entries come from the `entries` smallest ids, the only vectors that reach the driver.
    """
    longest, largest = rows.agg(F.max(F.size("embedding")), F.max(F.array_max(F.transform("embedding", F.abs)))).first()
    if longest is None:
        return None, 0
    width = max(1, -(-longest // parts))
    dims = width * parts
    limbs = 2 + (math.frexp(largest or 0.0)[1] + scale.bit_length() + 64) // LIMB  # sums of up to 2^64 rows
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    numbers = whole_numbers(pa.array([s[0] for s in seeds], pa.list_(pa.float64())), dims, width, scale).tolist()
    found = [[n[k * width : (k + 1) * width] for n in numbers] for k in range(parts)]
    for _ in range(rounds):
        found = moved(found, entry_sums(rows, Codebooks(found), dims, scale, limbs))
    return Codebooks(found), dims


def coded(rows: DataFrame, books: Codebooks | None, dims: int, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, codes, error): the code of every part, and the squared distances summed over the parts."""
    schema = "vec_id long, label long, codes array<int>, error long"
    if books is None:
        return rows.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                codes, errors = books.codes(whole_numbers(part.column(2), dims, books.width, scale))
                total = errors.sum(axis=1)
                errors = pa.array([e if e <= LONG else None for e in total.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(codes.tolist(), pa.list_(pa.int32())), errors], ["vec_id", "label", "codes", "error"])

    return rows.select("vec_id", "label", "embedding").mapInArrow(run, schema)


def with_label_error(codes: DataFrame, share: int = 256) -> DataFrame:
    """Add the error summed over equal labels, nulls together.

    Labels that hold more than 1/share of the rows, fewer than `share` in number, are broadcast; the others are joined by shuffle.
    """
    codes = staged(codes, "vector-codes")
    sums = staged(codes.groupBy("label").agg(F.count("*").alias("n"), F.try_sum("error").alias("label_error")), "label-errors")
    total = sums.agg(F.sum("n")).first()[0] or 0
    often = F.broadcast(sums.where(F.col("n") * share > total).select(F.col("label").alias("own"), "label_error"))
    rare = sums.where(F.col("n") * share <= total).select(F.col("label").alias("own"), "label_error")
    same = F.col("label").eqNullSafe(F.col("own"))
    return codes.join(often, same).drop("own").unionByName(codes.join(often, same, "left_anti").join(rare, same).drop("own"))


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    rows = kept(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    books, dims = trained(rows)
    found = with_label_error(coded(rows, books, dims))
    code = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    return found.select("vec_id", code.alias("code"), "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))


QUERIES = {"op13_vector_codes": op13_vector_codes}


def _sql() -> str:
    """The query over vectors of 64 components: assignment and means, unrolled over the rounds."""
    at = range(1, 17)
    apart = " + ".join(f"(p.v[{i}] - c.v[{i}]) * (p.v[{i}] - c.v[{i}])" for i in at)
    steps = [
        "e AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "p AS MATERIALIZED (SELECT vec_id, part, v[16 * part + 1 : 16 * part + 16] AS v FROM e, range(4) r(part))",
        "c0 AS MATERIALIZED (SELECT part, entry, v FROM (SELECT part, v, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p) WHERE entry < 256)",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, part, min(d * 256 + entry) AS best FROM (SELECT vec_id, p.part, entry, {apart} AS d FROM p JOIN c{k} c ON p.part = c.part) GROUP BY ALL)")
        if k < ROUNDS:
            sums = ", ".join(f"CAST(sum(v[{i}]) AS BIGINT)" for i in at)
            steps.append(f"s{k} AS MATERIALIZED (SELECT part, best % 256 AS entry, count(*) AS n, [{sums}] AS s FROM a{k} JOIN p USING (vec_id, part) GROUP BY ALL)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT part, entry, CASE WHEN n IS NULL THEN c.v ELSE list_transform(s, lambda x: (x - ((x % n) + n) % n) // n) END AS v FROM c{k} c LEFT JOIN s{k} USING (part, entry))")
    steps.append(f"f AS (SELECT vec_id, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)")
    digest = f"(SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM c{ROUNDS})"
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, {digest} AS codebooks_sha256 FROM f JOIN e USING (vec_id)"


SQL = {"op13_vector_codes": _sql()}
