"""Grids as cell rows (y, x, v): scaling, resampling, stencils, classification, blends.

Stencils are sums over a small offset table: every cell is sent to the cells
whose window holds it, then summed (rows first, then columns, where a kernel is
separable). Borders reflect without repeating the edge cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.operators import graph


def profile(cells: DataFrame) -> DataFrame:
    return cells.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), (F.max("v") - F.min("v")).alias("spread"), F.count("*").alias("n"), F.count_if(F.col("v") != 0).alias("n_set"))


def extent(cells: DataFrame) -> tuple[int, int]:
    """(width, height) of a grid that starts at (0, 0), read from its cells; (0, 0) without any."""
    found = cells.agg(F.max("x"), F.max("y")).first()
    return tuple(0 if n is None else n + 1 for n in found)


def checked(cells: DataFrame) -> DataFrame:
    """One row: the cell count, or an error when all cells are zero."""
    return cells.agg(F.when(F.count_if(F.col("v") != 0) == 0, F.raise_error(F.lit("all cells are zero"))).otherwise(F.count("*")).cast("long").alias("n"))


def with_scalars(cells: DataFrame, *aggregates: Column) -> DataFrame:
    """Add global aggregates (one row) to every cell."""
    return cells.crossJoin(F.broadcast(cells.agg(*aggregates)))


def height_scale(cells: DataFrame, least: float, ceiling: float, adjust: bool = True) -> DataFrame:
    scale = F.ceil(F.greatest(F.lit(least), F.max("v") + ceiling)).cast("double") if adjust else F.lit(float(least))
    return cells.agg(scale.alias("scale")).select("scale", (F.lit(65535.0) / F.col("scale")).alias("z_factor"), (F.col("scale") / 255).alias("multiplier"))


def raised(cells: DataFrame, plateau: int, depth: int) -> DataFrame:
    return with_scalars(cells, F.min("v").alias("lo")).withColumn("v", F.col("v") - F.col("lo") + plateau + depth).drop("lo")


def normalised(cells: DataFrame, scale: float) -> DataFrame:
    """Scale to 0..65535, clipped and truncated."""
    return cells.withColumn("v", F.greatest(F.lit(0.0), F.least(F.lit(65535.0), F.col("v") * 65535.0 / scale)).cast("long"))


def unit(cells: DataFrame) -> DataFrame:
    df = with_scalars(cells, F.min("v").alias("lo"), F.max("v").alias("hi"))
    return df.withColumn("u", F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)).drop("lo", "hi")


def resized_nearest(cells: DataFrame, width: int, height: int, new_width: int, new_height: int) -> DataFrame:
    """Every source cell is given to the target cells that look it up by floor(i * old / new)."""
    span = lambda c, old, new: F.sequence(F.ceil(F.col(c) * new / old), F.ceil((F.col(c) + 1) * new / old) - 1)
    some = lambda c, old, new: F.ceil(F.col(c) * new / old) <= F.ceil((F.col(c) + 1) * new / old) - 1
    rows = cells.where(some("x", width, new_width)).withColumn("nx", F.explode(span("x", width, new_width)))
    return rows.where(some("y", height, new_height)).withColumn("ny", F.explode(span("y", height, new_height))).select(F.col("ny").alias("y"), F.col("nx").alias("x"), "v")


def area_average(cells: DataFrame, k: int) -> DataFrame:
    return cells.groupBy(F.expr(f"y div {k}").alias("y"), F.expr(f"x div {k}").alias("x")).agg(F.avg("v").alias("v"))


def reflected(c: Column, size: int) -> Column:
    """Index reflected at both borders without repeating the edge."""
    period = 2 * (size - 1)
    m = F.pmod(c, F.lit(period))
    return F.when(m < size, m).otherwise(period - m)


def convolved_1d(cells: DataFrame, axis: str, size: int, weights: list[float]) -> DataFrame:
    """Weighted sums along one axis; offsets run from -(n // 2)."""
    half = len(weights) // 2
    table = F.array(*[F.struct(F.lit(k - half).cast("long").alias("o"), F.lit(w).alias("w")) for k, w in enumerate(weights)])
    other = "y" if axis == "x" else "x"
    # a target t sums source reflect(t + o); a source reaches t = s - o and, near borders, the mirrored ones
    mirrored = F.array(F.col(axis), -F.col(axis), 2 * (size - 1) - F.col(axis))
    rows = cells.withColumn("s", F.explode(F.array_distinct(mirrored))).withColumn("k", F.explode(table))
    rows = rows.withColumn("t", F.col("s") - F.col("k.o")).where((F.col("t") >= 0) & (F.col("t") < size))
    return rows.groupBy(other, F.col("t").alias(axis)).agg(F.sum(F.col("v") * F.col("k.w")).alias("v"))


def gaussian(n: int, sigma: float) -> list[float]:
    raw = [math.exp(-((k - n // 2) ** 2) / (2 * sigma * sigma)) for k in range(n)]
    return [w / sum(raw) for w in raw]


def centre_cut(cells: DataFrame, width: int, height: int, half_x: int, half_y: int) -> DataFrame:
    """The cells within half a size of the grid's centre; places count from the cut's corner."""
    x0, y0 = width // 2 - half_x, height // 2 - half_y
    inside = F.col("x").between(x0, x0 + 2 * half_x - 1) & F.col("y").between(y0, y0 + 2 * half_y - 1)
    return cells.where(inside).select((F.col("y") - y0).alias("y"), (F.col("x") - x0).alias("x"), "v")


def blurred(cells: DataFrame, width: int, height: int, weights: list[float]) -> DataFrame:
    return convolved_1d(convolved_1d(cells, "x", width, weights), "y", height, weights)


def masked_replace(cells: DataFrame, other: DataFrame, mask: DataFrame) -> DataFrame:
    """Values of `other` where the mask is set, of `cells` elsewhere."""
    marked = mask.select("y", "x").distinct().withColumn("m", F.lit(True))
    both = cells.join(other.withColumnRenamed("v", "o"), ["y", "x"]).join(marked, ["y", "x"], "left")
    return both.select("y", "x", F.when(F.col("m"), F.col("o")).otherwise(F.col("v")).alias("v"))


def neighbourhood(cells: DataFrame, value: str, half: int, width: int, height: int) -> DataFrame:
    """(y, x, dy, dx, n): values of the in-grid cells around each cell."""
    offsets = F.array(*[F.struct(F.lit(dy).cast("long").alias("dy"), F.lit(dx).cast("long").alias("dx")) for dy in range(-half, half + 1) for dx in range(-half, half + 1)])
    rows = cells.select("y", "x", F.col(value).alias("n"), F.explode(offsets).alias("o"))
    rows = rows.select((F.col("y") - F.col("o.dy")).alias("y"), (F.col("x") - F.col("o.dx")).alias("x"), "o.dy", "o.dx", "n")
    return rows.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))


def relief(cells: DataFrame, half: int, width: int, height: int) -> DataFrame:
    return neighbourhood(cells, "v", half, width, height).groupBy("y", "x").agg((F.max("n") - F.min("n")).alias("relief"))


def gradient(cells: DataFrame, width: int, height: int) -> DataFrame:
    """Squared 3 x 3 Sobel gradient of inner cells."""
    near = neighbourhood(cells, "v", 1, width, height)
    gx = F.sum(F.col("n") * F.col("dx") * F.when(F.col("dy") == 0, 2).otherwise(1))
    gy = F.sum(F.col("n") * F.col("dy") * F.when(F.col("dx") == 0, 2).otherwise(1))
    return near.groupBy("y", "x").agg(F.count("*").alias("c"), gx.alias("gx"), gy.alias("gy")).where("c = 9").select("y", "x", (F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("g2"))


def majority(cells: DataFrame, half: int, width: int, height: int) -> DataFrame:
    """Most frequent class of the in-grid window; ties go to the lowest class."""
    counts = neighbourhood(cells, "class", half, width, height).groupBy("y", "x", "n").agg(F.count("*").alias("c"))
    return counts.groupBy("y", "x").agg(F.max_by("n", F.struct("c", -F.col("n"))).alias("class"))


def extremes(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """Lowest and highest masked cell with their places; the first in row order on ties."""
    under = cells.join(mask.select("y", "x"), ["y", "x"], "left_semi")
    low = F.min(F.struct("v", "y", "x"))
    high = F.max(F.struct("v", (-F.col("y")).alias("y"), (-F.col("x")).alias("x")))
    m = under.agg(low.alias("a"), high.alias("b"))
    return m.select(F.col("a.v").alias("lo"), F.col("a.y").alias("lo_y"), F.col("a.x").alias("lo_x"), F.col("b.v").alias("hi"), (-F.col("b.y")).alias("hi_y"), (-F.col("b.x")).alias("hi_x"))


def shares(cells: DataFrame) -> DataFrame:
    counts = cells.groupBy("class").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(cells.agg(F.count("*").alias("total")))).select("class", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def components(cells: DataFrame) -> DataFrame:
    """(y, x, label): 8-neighbour components of a cell set; label = smallest y * 2^20 + x of the component."""
    found = graph.labelled(cells.select("y", "x"), diagonal=True)
    return found.select("y", "x", (F.expr(f"label div {graph.WIDE}") * (1 << 20) + F.col("label") % graph.WIDE).alias("label"))


def sampled(cells: DataFrame, points: DataFrame, width: int, height: int, z_factor: float) -> DataFrame:
    """Elevation at points (clamped, truncated), times a factor."""
    clamp = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.col(c).cast("long")))
    at = points.withColumn("x", clamp("px", width)).withColumn("y", clamp("py", height))
    return at.join(cells, ["y", "x"]).withColumn("z", F.col("v") * z_factor)


def mesh(cells: DataFrame, width: int, height: int, step: int) -> tuple[DataFrame, DataFrame]:
    """Vertices (vid, x, y, z) of every step-th cell, z = max - v, and two faces per quad (fid, v1, v2, v3)."""
    cols, rows = -(-width // step), -(-height // step)
    kept = with_scalars(cells, F.max("v").alias("hi")).where((F.col("x") % step == 0) & (F.col("y") % step == 0))
    i, j = F.expr(f"x div {step}"), F.expr(f"y div {step}")
    vertices = kept.select((j * cols + i).alias("vid"), "x", "y", (F.col("hi") - F.col("v")).alias("z"))
    quads = kept.where((i < cols - 1) & (j < rows - 1)).select((j * cols + i).alias("a"), (j * (cols - 1) + i).alias("q"))
    a = F.col("a")
    two = F.array(F.struct(F.lit(0).alias("t"), a.alias("v1"), (a + cols).alias("v2"), (a + cols + 1).alias("v3")), F.struct(F.lit(1).alias("t"), a.alias("v1"), (a + cols + 1).alias("v2"), (a + 1).alias("v3")))
    faces = quads.select("q", F.explode(two).alias("f")).select((F.col("q") * 2 + F.col("f.t")).alias("fid"), "f.v1", "f.v2", "f.v3")
    return vertices, faces


def wires(spans: DataFrame, steps: int = 10) -> DataFrame:
    """(wire_id, k, x, y, z) of sagging wires between (x1, y1, z1) and (x2, y2, z2); y is up, sag = clamp(3 % of the span, 0.35, 2)."""
    dx, dy, dz = (F.col(f"{c}2") - F.col(f"{c}1") for c in "xyz")
    sag = F.greatest(F.lit(0.35), F.least(F.lit(2.0), 0.03 * F.sqrt((dx * dx + dy * dy + dz * dz).cast("double"))))
    rows = spans.withColumn("sag", sag).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    t = F.col("k") / F.lit(float(steps))
    at = lambda c: F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * t
    return rows.select("wire_id", "k", at("x").alias("x"), (at("y") - 4 * F.col("sag") * t * (1 - t)).alias("y"), at("z").alias("z"))
