"""Maximal periodic runs of word sequences by online dyadic square catching.

A catcher stands over a completed block of L = 2^k words that starts at a multiple of L. It catches the
squares (a stretch of p words, twice in a row) whose first half holds its block: as words are appended, the
catcher looks for its block at every distance p that it is responsible for. A block found again opens a
suffix comparison at that distance: words p apart are compared backwards to the last difference, and
forwards with every word that is appended, until they differ. A comparison over at least p words is a new
square, and all squares of one comparison merge into one run, which is reported when the comparison closes.

Distances are dealt to block lengths so that a run of the least length always holds a whole block of its
distance: any stretch of 2L - 1 words holds an aligned block of L words. A distance p belongs to the largest
L with 2L - 1 <= max(p, least - p). Blocks are told by 64-bit hashes that double with L; a hash only opens a
comparison, which is made on the words, so the result is exact.

Words may be appended in portions of any size; the runs are the same. Only the words and, per block length,
the hashes within reach of the catchers are kept.

Defined results: null and empty texts have no words and no run; repeated rows are searched each; a null
doc_id is kept; extra columns are ignored; an empty table gives an empty result. Words are byte strings, so
texts that differ in letter case or normal form differ.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 12
PORTION = 1 << 15
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Distinct words that a task numbers before it starts anew (at a document's end).
KEPT_WORDS = 1 << 20


class Comparison:
    """Words `p` apart are equal from `start` on, so far up to `end`; open while no difference was met."""

    __slots__ = ("end", "start")

    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class Level:
    """The catchers over blocks of one length, for distances `low` to `high`."""

    def __init__(self, length: int, low: int, high: int):
        self.length, self.low, self.high = length, low, high
        self.hashes, self.base = np.zeros(0, dtype=np.uint64), 0
        self.open: dict[int, Comparison] = {}


@lru_cache(None)
def level_distances(length: int, least: int) -> tuple[int, int]:
    """The first and last distance whose blocks have this length; first > last where there is none."""
    fits = lambda p: 1 << (max(p, least - p) + 1).bit_length() - 2  # noqa: E731  the largest L with 2L - 1 <= max(p, least - p)
    found = [p for p in range(1, max(4 * length, least)) if fits(p) == length]
    return (found[0], found[-1]) if found else (1, 0)


class Catchers:
    """Online search: append() takes the next words as numbers, runs() gives (start, length, period) of all runs by start, then period."""

    def __init__(self, least: int = LEAST):
        self.least, self.n = least, 0
        self.words = np.zeros(64, dtype=np.int64)
        self.levels: list[Level] = []
        #: Closed comparisons that hold a square: first word and word after the last -> smallest period.
        self.found: dict[tuple[int, int], int] = {}

    def append(self, words: np.ndarray) -> None:
        if not len(words):
            return
        if self.n + len(words) > len(self.words):
            grown = np.zeros(max(2 * len(self.words), self.n + len(words)), dtype=np.int64)
            grown[: self.n] = self.words[: self.n]
            self.words = grown
        self.words[self.n : self.n + len(words)] = words
        before, self.n = self.n, self.n + len(words)
        while not self.levels or 2 * self.levels[-1].length <= self.n:
            length = 2 * self.levels[-1].length if self.levels else 1
            self.levels.append(Level(length, *level_distances(length, self.least)))
        for k, level in enumerate(self.levels):
            self._hash(level, self.levels[k - 1] if k else None)
        for level in self.levels:
            for p in list(level.open):
                self._forwards(level, p)
            if level.low <= level.high:
                self._catch(level, before)
        for level in self.levels:
            # behind the catchers' reach, and behind what the next length doubles
            keep = max(level.base, self.n - level.length + 1 - max(level.high, level.length) - level.length)
            level.hashes, level.base = level.hashes[keep - level.base :], keep

    def _hash(self, level: Level, half: Level | None) -> None:
        """Hashes of the windows that end in the new words."""
        first, last = level.base + len(level.hashes), self.n - level.length
        if first > last:
            return
        if half is None:
            new = (self.words[first : last + 1].astype(np.uint64) + np.uint64(1)) * MIX
        else:
            at = first - half.base
            left = half.hashes[at : at + last - first + 1]
            new = (left ^ (left >> np.uint64(29))) * MIX + half.hashes[at + half.length : at + half.length + last - first + 1]
        level.hashes = np.concatenate((level.hashes, new)) if len(level.hashes) else new

    def _catch(self, level: Level, before: int) -> None:
        """Blocks that come again in windows which end in the new words open comparisons."""
        size, low, high = level.length, level.low, level.high
        first, last = max(0, before - size + 1), self.n - size  # places of the new windows
        block = max(level.base, first - high, 0)
        block += -block % size
        if block + low > last:
            return
        hashes = level.hashes[block - level.base :]
        reach = np.zeros(len(hashes) + high, dtype=np.uint64)  # zeros past the end; places are checked below
        reach[: len(hashes)] = hashes
        own = hashes[: last - low - block + 1 : size]
        near = np.ndarray((len(own), high - low + 1), np.uint64, reach, 8 * low, (8 * size, 8))  # per block the windows at its distances
        row, column = (near == own[:, None]).nonzero()
        if not len(row):
            return
        at, p = row * size + block, column + low
        new = (at + p >= first) & (at + p <= last)
        at, p = at[new], p[new]
        if not len(at):
            return
        inside = self._inside_runs(at, p, size)
        for i, q in zip(at[~inside].tolist(), p[~inside].tolist(), strict=True):
            known = level.open.get(q)
            if known is not None and i < known.end:
                continue
            if known is not None:
                self._close(q, known)
            start = self._backwards(i, q)
            level.open[q] = Comparison(start, i)
            self._forwards(level, q, keep_closed=True)
        for q in [q for q, c in level.open.items() if c.end < self.n - q]:
            self._close(q, level.open.pop(q))

    def _inside_runs(self, at: np.ndarray, p: np.ndarray, size: int) -> np.ndarray:
        """Blocks that lie with their copy in a run whose period divides p: that run's squares, or none, but no other run's."""
        inside = np.zeros(len(at), dtype=bool)
        runs = [(s, e + q, q) for level in self.levels for q, c in level.open.items() for s, e in ((c.start, c.end),) if e - s >= q]
        runs += [(s, e, q) for (s, e), q in self.found.items() if e > at[0]]
        for s, e, q in runs:
            a, b = np.searchsorted(at, (s, e))
            if a < b:
                inside[a:b] |= (at[a:b] + p[a:b] + size <= e) & (p[a:b] % q == 0) & (p[a:b] > q)
        return inside

    def _backwards(self, i: int, p: int) -> int:
        step = 16
        while i:
            low = max(0, i - step)
            same = self.words[low:i] == self.words[low + p : i + p]
            if not same.all():
                return low + len(same) - int(same[::-1].argmin())
            i, step = low, min(2 * step, PORTION)
        return 0

    def _forwards(self, level: Level, p: int, keep_closed: bool = False) -> None:
        """Advance the comparison at distance p by the words known; a difference closes it."""
        found, step = level.open[p], 16
        top = self.n - p
        while found.end < top:
            high = min(top, found.end + step)
            same = self.words[found.end : high] == self.words[found.end + p : high + p]
            if not same.all():
                found.end += int(same.argmin())
                if not keep_closed:
                    self._close(p, level.open.pop(p))
                return
            found.end, step = high, min(2 * step, PORTION)

    def _close(self, p: int, done: Comparison) -> None:
        if done.end - done.start >= max(p, self.least - p):
            place = (done.start, done.end + p)
            self.found[place] = min(p, self.found.get(place, p))

    def runs(self) -> list[tuple[int, int, int]]:
        for level in self.levels:
            for p in list(level.open):
                self._close(p, level.open.pop(p))
        return sorted(((s, e - s, p) for (s, e), p in self.found.items()), key=lambda r: (r[0], r[2]))


def runs_of(words: np.ndarray, least: int = LEAST, portion: int = PORTION) -> list[tuple[int, int, int]]:
    """All runs of a sequence of numbers, appended in portions."""
    catchers = Catchers(least)
    for at in range(0, len(words), portion):
        catchers.append(words[at : at + portion])
    return catchers.runs()


def numbered(words: list[bytes], numbers: dict[bytes, int]) -> np.ndarray:
    for w in set(words).difference(numbers):
        numbers[w] = len(numbers)
    return np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))


def periodic_runs(docs: DataFrame, least: int = LEAST, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): runs = array of (start, length, period); collapsed = the words that are in no run after its first period, joined by spaces.

    A run is a longest stretch of consecutive words with smallest period q and at least max(least, 2 q) words.
    edit(doc_id, words), if given, is applied to every document's words before the search.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        numbers: dict[bytes, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts, found, texts = [], [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = (text or b"").split()  # bytes: the six ASCII white-space bytes only
                    if edit is not None:
                        words = edit(doc, words)
                    if len(numbers) > KEPT_WORDS:
                        numbers.clear()
                    runs = runs_of(numbered(words, numbers), least)
                    counts.append(len(words))
                    found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                    if runs:
                        stay = np.ones(len(words), dtype=bool)
                        for s, n, q in runs:
                            stay[s + q : s + n] = False
                        words = [words[i] for i in np.flatnonzero(stay)]
                    texts.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(texts, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    found = source.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(doc: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a periodic end in a tenth of the documents, by the document's number; null numbers keep their words."""
    h = zlib.crc32(str(doc).encode())
    n, g = len(words), h // 10
    if doc is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    first = words[a : a + p]
    return words[:a] + (first * (-(-(n - a) // p)))[: n - a]


def op11_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every document after planted(): their number, the longest one, and digests of all runs and of the collapsed text."""
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), edit=planted)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    rows = found.withColumn("top", longest)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.expr("(1000 * top.length) div (-top.period)").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op11_runs": op11_runs}
SQL: dict[str, str] = {}
