"""Connected components of edge tables and of cell sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A cell's number: y * WIDE + x, for places below 2^30 either way.
WIDE = 1 << 31


def components(edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, node, component): the smallest node reachable, for every node with an edge (keys, a, b) to another one.

    Large-star and small-star rounds in turn: every node's larger neighbours, then its smaller ones, are linked to the
    smallest of them, so edges never grow in number; every round is checkpointed, the last one changes nothing.
    """
    low_first = lambda e: e.where("a <> b").select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = low_first(edges).checkpoint(), None
    while True:
        both = edges.unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(*keys, "a").agg(F.min("b").alias("low")).withColumn("low", F.least("low", "a"))
        large = low_first(both.join(low, [*keys, "a"]).where("b > a").select(*keys, F.col("b").alias("a"), F.col("low").alias("b")))
        low = large.groupBy(*keys, "a").agg(F.min("b").alias("low"))
        pair = lambda a: F.struct(F.col(a).alias("a"), F.col("low").alias("b"))
        edges = low_first(large.join(low, [*keys, "a"]).select(*keys, F.inline(F.array(pair("a"), pair("b"))))).checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    found = edges.select(*keys, F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(edges.select(*keys, F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node reachable of nodes 0..n-1 with edges (a, b)."""
    parent = np.arange(n)
    while True:
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        if (low == high).all():
            return parent
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def tile_labels(y: np.ndarray, x: np.ndarray, diagonal: bool) -> np.ndarray:
    """The number of the first cell, in row order, of each cell's component; by runs of cells in a row."""
    order = np.lexsort((x, y))
    y, x = y[order], x[order]
    starts = np.flatnonzero(np.concatenate(([True], (np.diff(y) != 0) | (np.diff(x) != 1))))
    stops = np.append(starts[1:], len(y)) - 1
    row, low, high = y[starts], x[starts], x[stops]
    reach = 1 if diagonal else 0
    # runs of the row above that meet a run: those from the first that does not end before it, up to the last that starts in it
    wide = int(x.max() - x.min()) + 4
    place = lambda r, c: (r - y[0] + 1) * wide + (c - x.min() + 1)
    first = np.searchsorted(place(row, high), place(row - 1, low - reach))
    last = np.searchsorted(place(row, low), place(row - 1, high + reach), side="right")
    n = np.maximum(0, last - first)
    a = np.repeat(np.arange(len(starts)), n)
    b = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    run = joined(len(starts), a, b)
    out = np.empty(len(y), dtype=np.int64)
    out[order] = np.repeat((row * WIDE + low)[run], stops - starts + 1)
    return out


def labelled(cells: DataFrame, keys: tuple[str, ...] = (), diagonal: bool = False, tile: int = 512) -> DataFrame:
    """(keys, y, x, label): components of cell sets (keys, y, x), each key's own; label = the number of the component's first cell.

    Tiles are labelled one by one; labels that meet across a tile's border are joined as a small edge table. A task
    holds one tile of one key at a time.
    """
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    own = cells.select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).distinct()
    tiled = own.withColumn("ty", F.floor(F.col("y") / tile)).withColumn("tx", F.floor(F.col("x") / tile))

    def run(table: pa.Table) -> pa.Table:
        label = tile_labels(table["y"].to_numpy(), table["x"].to_numpy(), diagonal)
        return table.select([*keys, "y", "x"]).append_column("label", pa.array(label))

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "y long, x long, label long"])
    local = tiled.groupBy(*keys, "ty", "tx").applyInArrow(run, schema).checkpoint()
    last = lambda c: F.pmod(F.col(c), F.lit(tile)) == tile - 1
    firsts = lambda c: F.pmod(F.col(c), F.lit(tile)) == 0
    step = lambda dy, dx: F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"))
    right = [step(0, 1), *([step(-1, 1), step(1, 1)] if diagonal else [])]
    down = [step(1, 0), *([step(1, -1), step(1, 1)] if diagonal else [])]
    ahead = local.where(last("x")).withColumn("s", F.explode(F.array(*right))).unionByName(local.where(last("y")).withColumn("s", F.explode(F.array(*down))))
    ahead = ahead.select(*keys, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), F.col("label").alias("a"))
    met = local.where(firsts("x") | firsts("y") | last("x") | last("y")).withColumnRenamed("label", "b")
    edges = ahead.join(met, [*keys, "y", "x"]).select(*keys, "a", "b").distinct().checkpoint()
    if edges.isEmpty():
        return local
    whole = components(edges, keys).withColumnRenamed("node", "label")
    # the smallest number is that of the first cell in row order
    return local.join(whole, [*keys, "label"], "left").select(*keys, "y", "x", F.coalesce("component", "label").alias("label"))
