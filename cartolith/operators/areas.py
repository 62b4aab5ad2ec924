"""Clean-up of areas as cell sets (keys, y, x): growing, closing gaps, cutting, narrow bridges, insets, slivers.

Structuring elements are squares: `n` is a distance in cells along rows and columns. A part is a connected set of
cells that share an edge; its number is that of its first cell (see graph.WIDE), so parts of one key never share it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartolith.operators import cells as C
from cartolith.operators import graph

Keys = tuple[str, ...]
#: Rounds in which narrow bridges are looked for.
ROUNDS = 3


def _banded(cells: DataFrame, along: str, gap: int, by: int, keys: Keys) -> DataFrame:
    """Stretches of cells along one axis, with gaps of up to `gap` cells inside, made longer by `by` cells at both ends."""
    other = "y" if along == "x" else "x"
    line = Window.partitionBy(*keys, other).orderBy(along)
    opens = F.coalesce(F.col(along) - F.lag(along).over(line) > gap + 1, F.lit(True))
    numbered = cells.withColumn("opens", opens.cast("int")).withColumn("k", F.sum("opens").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    spans = numbered.groupBy(*keys, other, "k").agg((F.min(along) - by).alias("low"), (F.max(along) + by).alias("high")).where("low <= high")
    return spans.select(*keys, other, F.explode(F.sequence("low", "high")).alias(along)).select(*keys, "y", "x")


def grown(cells: DataFrame, n: int, keys: Keys = ()) -> DataFrame:
    """Cells within n of a set cell (a square), on the open plane: along rows, then along columns."""
    own = cells.select(*keys, "y", "x").distinct()
    return own if n <= 0 else _banded(_banded(own, "x", 2 * n, n, keys), "y", 2 * n, n, keys)


def shrunk(cells: DataFrame, n: int, keys: Keys = ()) -> DataFrame:
    """Cells whose neighbours within n are all set."""
    own = cells.select(*keys, "y", "x").distinct()
    return own if n <= 0 else _banded(_banded(own, "x", 0, -n, keys), "y", 0, -n, keys)


def merged(cells: DataFrame, distance: int, keys: Keys = ()) -> DataFrame:
    """Closing: gaps of up to twice the distance between cells of one key are filled; nothing is lost."""
    return shrunk(grown(cells, distance, keys), distance, keys)


def distance_after_cut(distance: float, split_width: float) -> float:
    """How far gaps are closed after areas were cut, so that cuts are not bridged again."""
    return min(distance, max(0.25, 0.2 * split_width)) if split_width > 0 else distance


def parts(cells: DataFrame, keys: Keys = (), least: float = 0) -> DataFrame:
    """(keys, part, y, x): connected parts with more than `least` cells."""
    found = graph.labelled(cells, keys).withColumnRenamed("label", "part")
    return found.select(*keys, "part", "y", "x") if least <= 0 else larger(found.select(*keys, "part", "y", "x"), F.lit(least), keys)


def larger(found: DataFrame, least: Column, keys: Keys = ()) -> DataFrame:
    """Parts with more than `least` cells."""
    sizes = found.groupBy(*keys, "part").agg(F.count("*").alias("cells"))
    return found.join(sizes.where(F.col("cells") > least), [*keys, "part"], "left_semi")


def split_narrow(found: DataFrame, width: float, keys: Keys = (), rounds: int = ROUNDS) -> DataFrame:
    """Parts (keys, part, y, x) broken where a bridge narrower than `width` is the only connection, in up to `rounds` rounds.

    With r = width / 2: a part is shrunk by r; of the pieces that are left, those above max(2 r^2, 1 % of the part) are
    seeds. A part with two seeds or more becomes their growths by r inside the part, cells that several reach going to the
    larger seed (the smaller number of equal ones), in connected parts above max(r^2, 0.5 % of the part). Where fewer
    than two of these are left, the part stays as it was. Cells that no seed reaches are dropped with the bridge.
    """
    n, r = int(width // 2), width / 2
    if n <= 0:
        return found
    own = (*keys, "part")
    for _ in range(rounds):
        found = found.checkpoint()
        sizes = found.groupBy(*own).agg(F.count("*").alias("cells"))
        pieces = graph.labelled(shrunk(found, n, own), own).withColumnRenamed("label", "seed")
        counted = pieces.groupBy(*own, "seed").agg(F.count("*").alias("size")).join(sizes, list(own))
        seeds = counted.where(F.col("size") > F.greatest(F.lit(2 * r * r), 0.01 * F.col("cells")))
        several = seeds.groupBy(*own).agg(F.count("*").alias("n")).where("n > 1").drop("n")
        seeds = seeds.join(several, list(own), "left_semi").select(*own, "seed", "size").checkpoint()
        if seeds.isEmpty():
            return found
        reached = grown(pieces.join(seeds, [*own, "seed"], "left_semi"), n, (*own, "seed")).join(found, [*own, "y", "x"], "left_semi")
        claimed = reached.join(seeds, [*own, "seed"]).groupBy(*own, "y", "x").agg(F.max_by("seed", F.struct("size", -F.col("seed"))).alias("seed"))
        lobes = graph.labelled(claimed, (*own, "seed")).withColumnRenamed("label", "lobe")
        lobe_sizes = lobes.groupBy(*own, "seed", "lobe").agg(F.count("*").alias("size")).join(sizes, list(own))
        kept = lobe_sizes.where(F.col("size") > F.greatest(F.lit(r * r), 0.005 * F.col("cells")))
        broken = kept.groupBy(*own).agg(F.count("*").alias("n")).where("n > 1").drop("n").checkpoint()
        if broken.isEmpty():
            return found
        new = lobes.join(kept.join(broken, list(own), "left_semi"), [*own, "seed", "lobe"], "left_semi")
        rest = found.join(broken, list(own), "left_anti")
        found = rest.unionByName(new.select(*keys, F.col("lobe").alias("part"), "y", "x"))
    return found


def inset(found: DataFrame, distance: int, keys: Keys = ()) -> DataFrame:
    """Parts shrunk by a distance; new parts above max(0.25 d^2, 0.1 % of the part) stay, and the part itself where there is none."""
    if distance <= 0:
        return found
    own = (*keys, "part")
    sizes = found.groupBy(*own).agg(F.count("*").alias("cells"))
    inner = graph.labelled(shrunk(found, distance, own), own).withColumnRenamed("label", "inner")
    counted = inner.groupBy(*own, "inner").agg(F.count("*").alias("size")).join(sizes, list(own))
    kept = counted.where(F.col("size") > F.greatest(F.lit(0.25 * distance * distance), 0.001 * F.col("cells"))).select(*own, "inner").checkpoint()
    new = inner.join(kept, [*own, "inner"], "left_semi").select(*keys, F.col("inner").alias("part"), "y", "x")
    return new.unionByName(found.join(kept.select(*own).distinct(), list(own), "left_anti"))


def cleaned(found: DataFrame, min_cells: float, min_width: float, keys: Keys = ()) -> DataFrame:
    """Parts without slivers: opened by half the least width, then connected parts of min_cells or more."""
    n, own = int(min_width // 2), (*keys, "part")
    opened = grown(shrunk(found, n, own), n, own) if n > 0 else found
    new = graph.labelled(opened, own).withColumnRenamed("label", "new")
    sizes = new.groupBy(*own, "new").agg(F.count("*").alias("size")).where(F.col("size") >= min_cells)
    return new.join(sizes, [*own, "new"], "left_semi").select(*keys, F.col("new").alias("part"), "y", "x")


def flat_ribbons(lines: DataFrame, half_width: int, key: str = "way_id") -> DataFrame:
    """(key, y, x): cells whose centre lies within half_width of a line of whole-number vertices; flat ends, round joins."""
    return C.run_cells(C.pieces(flat_ribbon_spans(lines, half_width, key), (key,), crowded=False)).select(key, "y", "x")


def flat_ribbon_spans(lines: DataFrame, half_width: int, key: str = "way_id") -> DataFrame:
    """(key, y, low, high): spans of the cells of flat ribbons, those of several segments may overlap.

    A segment fills one span of every row: |cross product| <= half_width * length and 0 <= dot product <= length squared,
    as bounds of x - x1. Joins are discs around the vertices between the ends.
    """
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    own = C.segments(lines, key).withColumn("dx", dx).withColumn("dy", dy).withColumn("l2", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).where("l2 > 0")
    own = own.withColumn("far", F.floor(half_width * F.sqrt(F.col("l2").cast("double"))))
    rows = own.withColumn("y", F.explode(F.sequence(F.least("y1", "y2") - half_width, F.greatest("y1", "y2") + half_width))).withColumn("v", F.col("y") - F.col("y1"))
    wide, tall = F.nullif(F.col("dx"), F.lit(0)), F.nullif(F.col("dy"), F.lit(0))
    side = [(F.col("dx") * F.col("v") + s * F.col("far")) / tall for s in (-1, 1)]
    ends = [(e - F.col("dy") * F.col("v")) / wide for e in (F.lit(0), F.col("l2"))]
    level = F.col("dy").isNotNull() & ((F.col("dy") != 0) | (F.abs(F.col("dx") * F.col("v")) <= F.col("far")))
    upright = (F.col("dx") != 0) | (F.col("dy") * F.col("v")).between(F.lit(0), F.col("l2"))
    low, high = F.ceil(F.greatest(F.least(*side), F.least(*ends))), F.floor(F.least(F.greatest(*side), F.greatest(*ends)))
    spans = rows.where(level & upright).select(key, "y", (F.col("x1") + low).alias("low"), (F.col("x1") + high).alias("high")).where("low <= high")
    order = Window.partitionBy(key).orderBy("seq")
    between = lines.withColumn("inner", F.lag("x").over(order).isNotNull() & F.lead("x").over(order).isNotNull()).where("inner")
    return spans.unionByName(C.disc_spans(between.select(key, "x", "y"), half_width).select(key, "y", "low", "high"))


def component_ribbons(lines: DataFrame, links: DataFrame, half_width: int) -> DataFrame:
    """(component, y, x): the joint ribbons of lines that are connected by links (a, b); a line without a link is its own component."""
    return C.run_cells(component_spans(lines, links, half_width)).select("component", "y", "x")


def component_spans(lines: DataFrame, links: DataFrame, half_width: int) -> DataFrame:
    """(component, y, low, high): component_ribbons() as disjoint spans."""
    found = graph.components(links).select(F.col("node").alias("way_id"), "component")
    named = lines.join(found, "way_id", "left").withColumn("component", F.coalesce("component", "way_id"))
    spans = flat_ribbon_spans(named.select(F.struct("component", "way_id").alias("line"), "seq", "x", "y"), half_width, "line")
    return C.pieces(spans.select("line.component", "y", "low", "high"), ("component",))


def water_parts(lines: DataFrame, areas: DataFrame, half_width: int, growth: int = 2) -> DataFrame:
    """(part, y, x): water surfaces: ribbons of lines with `growth` cells more on either side, and areas grown by it, in connected parts."""
    bands = C.run_cells(C.pieces(flat_ribbon_spans(lines, half_width + growth).drop("way_id"))).select("y", "x")
    return parts(bands.unionByName(grown(areas, growth)))


def cleaned_up(
    targets: DataFrame,
    cuts: DataFrame | None = None,
    holes: DataFrame | None = None,
    *,
    split_width: float = 0,
    merge_distance: float = 0,
    narrow_width: float = 0,
    shrink: int = 0,
    min_cells: float = 0,
    min_width: float = 0,
) -> DataFrame:
    """(group, part, y, x): the whole clean-up of target areas (group, y, x), each group on its own.

    In order: cells of `cuts` (y, x) go; gaps are closed, conservatively where areas were cut; `holes` (y, x) and the
    cells of all other groups' targets go; parts are broken at narrow bridges, inset and freed from slivers.
    """
    keys = ("group",)
    own = targets.select("group", "y", "x").distinct().checkpoint()
    work = own
    if cuts is not None and split_width > 0:
        work = work.join(cuts.select("y", "x").distinct(), ["y", "x"], "left_anti")
        merge_distance = distance_after_cut(merge_distance, split_width)
    work = merged(work, int(merge_distance), keys)
    if holes is not None:
        work = work.join(holes.select("y", "x").distinct(), ["y", "x"], "left_anti")
    # the other groups' targets: a cell stays when the first and the last group that claim it are its own
    claims = own.groupBy("y", "x").agg(F.min("group").alias("low"), F.max("group").alias("high"))
    work = work.join(claims, ["y", "x"], "left").where("low IS NULL OR (low = group AND high = group)").select("group", "y", "x")
    found = split_narrow(parts(work, keys), narrow_width, keys)
    found = cleaned(inset(found, shrink, keys), min_cells, min_width, keys) if min_cells > 0 or min_width > 0 else inset(found, shrink, keys)
    return found.select("group", "part", "y", "x")


def report(targets: DataFrame, found: DataFrame) -> DataFrame:
    """(group, cells_in, parts, cells_out): what a clean-up did to every group."""
    before = targets.select("group", "y", "x").distinct().groupBy("group").agg(F.count("*").alias("cells_in"))
    after = found.groupBy("group").agg(F.count_distinct("part").alias("parts"), F.count("*").alias("cells_out"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return before.join(after, "group", "left").select("group", "cells_in", none("parts"), none("cells_out"))


@dataclass(frozen=True)
class CleanUp:
    """Which steps a usage asks for; distances in cells."""

    enabled: bool = True
    split: bool = False
    merge: bool = False
    add_holes: bool = False
    padding: int = 0
    split_width: float = 5.0
    merge_distance: float = 2.0
    narrow_width: float = 0.0
    min_cells: float = 0.0
    min_width: float = 0.0

    def asks(self) -> bool:
        return self.enabled and (self.split or self.merge or self.add_holes or self.padding > 0)


def per_usage(targets: DataFrame, settings: dict[str, CleanUp], cuts: DataFrame, holes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean-up of targets (usage, group, y, x), usage by usage: the parts (usage, group, part, y, x) and a report.

    A usage that asks for nothing, or that fails, keeps its cells, in connected parts; the report (usage, state, error,
    cells_in, cells_out, parts) says skipped or failed with the first line of the error, and the other usages go on.
    Usages without settings are not in the result.
    """
    spark, found, states = targets.sparkSession, [], []
    for usage, own in settings.items():
        cells = targets.where(F.col("usage") == usage).select("group", "y", "x")
        state, error, result = "skipped", None, None
        if own.asks():
            try:
                result = cleaned_up(
                    cells, cuts if own.split else None, holes if own.add_holes else None, split_width=own.split_width if own.split else 0, merge_distance=own.merge_distance if own.merge else 0,
                    narrow_width=own.narrow_width, shrink=own.padding, min_cells=own.min_cells, min_width=own.min_width,
                ).checkpoint()
                state = "done"
            except (PySparkException, Py4JError) as problem:
                state, error = "failed", str(problem).strip().split("\n")[0]
        found.append((parts(cells, ("group",)) if result is None else result).withColumn("usage", F.lit(usage)))
        states.append((usage, state, error))
    if not found:
        raise ValueError("no usages")
    every = reduce(DataFrame.unionByName, found).select("usage", "group", "part", "y", "x").checkpoint()
    count = lambda df, name: df.groupBy("usage").agg(F.count("*").alias(name))
    after = every.groupBy("usage").agg(F.count("*").alias("cells_out"), F.count_distinct("group", "part").alias("parts"))
    rows = spark.createDataFrame(states, "usage string, state string, error string").join(count(targets, "cells_in"), "usage", "left").join(after, "usage", "left")
    return every, rows.select("usage", "state", "error", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("cells_in", "cells_out", "parts")])
