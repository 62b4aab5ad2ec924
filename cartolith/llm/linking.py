"""Links between fingerprints that share a bucket key, and connected components of links.

Buckets of up to `small` members are compared in the JVM, as bounded arrays.
Larger ones are cut into blocks; every pair of blocks is one group of bounded
size, in which a breadth-first walk finds the same connectivity as all pairs
would, and emits at most one edge per member.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm.common import join_checked, staged

SMALL_BUCKET = 48
BLOCK = 2048


def forest(fp: np.ndarray, max_bits: int, accept: Callable[[int, int], bool] | None = None) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest over positions whose fingerprints differ in at most max_bits bits.

    accept(i, j), if given, must also hold for an edge. Each position joins the
    walk once and is compared only with positions not yet reached.
    """
    fp = fp.astype(np.int64, copy=False).view(np.uint64)  # of a negative number only the absolute value's bits are counted
    left = np.arange(len(fp))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[i]) <= max_bits
            if accept is not None and near.any():
                near[near] = [accept(int(i), int(j)) for j in left[near]]
            for j in left[near]:
                queue.append(j)
                yield int(i), int(j)
            left = left[~near]


def live_rows(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows (key, fp, main) of keys that can give a link, with bucket size n; the keys are counted first.

    A key needs two members, one of them with main = true.
    """
    keys = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("main").alias("any_main"))
    keys = staged(keys.where("n > 1 AND any_main").select("key", "n"), f"{name}-keys")
    live = staged(join_checked(rows, keys, ["key"], "inner", 32), f"{name}-live")
    return live.where(F.col("n") <= SMALL_BUCKET), live.where(F.col("n") > SMALL_BUCKET)


def small_pairs(rows: DataFrame, max_bits: int) -> DataFrame:
    """All pairs (a, b), a < b, of small buckets within max_bits bits; the arrays hold SMALL_BUCKET rows at most."""
    grouped = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("fp", "main"))).alias("m"))
    firsts = grouped.select("m", F.posexplode("m").alias("i", "x"))
    pairs = firsts.select(
        F.col("x.fp").alias("a"),
        F.explode(
            F.filter(
                F.slice("m", F.col("i") + 2, F.lit(SMALL_BUCKET)),
                lambda y: (y["main"] | F.col("x.main")) & (F.bit_count(y["fp"].bitwiseXOR(F.col("x.fp"))) <= max_bits),
            )
        ).alias("y"),
    )
    return pairs.select("a", F.col("y.fp").alias("b"))


def block_pairs(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Rows of large buckets, copied into every pair of blocks (key, bi, bj) that holds them."""
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    own = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.select(*keep, F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"))


def large_pairs(rows: DataFrame, max_bits: int) -> DataFrame:
    """Spanning edges (a, b) of large buckets."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].drop_duplicates().to_numpy()
        edges = np.array(list(forest(fp, max_bits)), dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": fp[edges[:, 0]], "b": fp[edges[:, 1]]})

    return block_pairs(rows, ["key", "fp"]).groupBy("key", "bi", "bj").applyInPandas(walk, "a long, b long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge (a, b).

    Alternating large-star and small-star rounds; each replaces a node's links
    by links to its smallest neighbour, so the number of edges never grows.
    Every round is written to the shared folder.
    """
    flat = lambda e: e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = staged(flat(edges), name)
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = staged(flat(large), name)
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        small = small.select(F.explode(F.array(F.struct(F.col("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = staged(flat(small), name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
