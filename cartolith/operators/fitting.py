"""Rotation of grids about their centre, and fitting of lines and convex areas into the bounds of a map."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartolith.operators.rings import clipped


def rotated_grid(cells: DataFrame, angle: float, width: int, height: int, out_width: int, out_height: int) -> DataFrame:
    """(y, x, v): the centre of a grid turned by an angle in degrees (counterclockwise as seen, y down), bilinear, 0 outside.

    The turn is about (width // 2, height // 2); out_width x out_height cells around it are cut out, places count from the
    cut's corner. A cell of the cut reads the four source cells around its place before the turn.
    """
    spark = cells.sparkSession
    cx, cy, turn = width // 2, height // 2, math.radians(angle)
    grid = spark.range(out_height).select(F.col("id").alias("ty"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(out_width - 1).cast("long"))).alias("tx"))
    dx, dy = F.col("tx") - out_width // 2, F.col("ty") - out_height // 2
    # rounded, so that quarter turns meet cells exactly
    sx, sy = F.round(math.cos(turn) * dx - math.sin(turn) * dy + cx, 9), F.round(math.sin(turn) * dx + math.cos(turn) * dy + cy, 9)
    two = lambda c: F.array(F.struct(F.floor(c).alias("at"), (1 - (c - F.floor(c))).alias("w")), F.struct((F.floor(c) + 1).alias("at"), (c - F.floor(c)).alias("w")))
    near = grid.withColumn("a", F.explode(two(sy))).withColumn("b", F.explode(two(sx))).select("ty", "tx", F.col("a.at").alias("y"), F.col("b.at").alias("x"), (F.col("a.w") * F.col("b.w")).alias("w"))
    read = near.join(cells.select("y", "x", "v"), ["y", "x"], "left")
    return read.groupBy(F.col("ty").alias("y"), F.col("tx").alias("x")).agg(F.sum(F.coalesce("v", F.lit(0)) * F.col("w")).alias("v"))


def turned(x: Column, y: Column, angle: float, centre: tuple[float, float], shift: tuple[float, float]) -> tuple[Column, Column]:
    """Places turned by -angle degrees about a centre and shifted."""
    a = math.radians(-angle)
    dx, dy = x - centre[0], y - centre[1]
    return centre[0] + math.cos(a) * dx - math.sin(a) * dy + shift[0], centre[1] + math.sin(a) * dx + math.cos(a) * dy + shift[1]


def fitted_lines(lines: DataFrame, low: float, high: float, angle: float = 0, centre: tuple[float, float] = (0, 0), shift: tuple[float, float] = (0, 0)) -> tuple[DataFrame, DataFrame]:
    """Lines (way_id, seq, x, y) turned, shifted and cut to the square low..high: the fitted ones (way_id, seq, x, y), and (way_id, parts) of the rejected.

    A line fits when what is left is one part of some length; lines in several parts, outside, or of one place are rejected.
    """
    x, y = turned(F.col("x"), F.col("y"), angle, centre, shift)
    order = Window.partitionBy("way_id").orderBy("seq")
    p = lines.select("way_id", "seq", x.cast("double").alias("x1"), y.cast("double").alias("y1")).withColumn("x2", F.lead("x1").over(order)).withColumn("y2", F.lead("y1").over(order)).where("x2 IS NOT NULL AND (x1 <> x2 OR y1 <> y2)")
    t0, t1 = F.lit(0.0), F.lit(1.0)
    for c in "xy":
        d, a = F.col(f"{c}2") - F.col(f"{c}1"), F.col(f"{c}1")
        inside = a.between(F.lit(float(low)), F.lit(float(high)))
        s, e = (low - a) / F.nullif(d, F.lit(0.0)), (high - a) / F.nullif(d, F.lit(0.0))
        t0 = F.greatest(t0, F.when(d != 0, F.least(s, e)).when(inside, 0.0).otherwise(2.0))
        t1 = F.least(t1, F.when(d != 0, F.greatest(s, e)).otherwise(1.0))
    cut = p.withColumn("t0", t0).withColumn("t1", t1).where("t0 < t1")
    # a part goes on when the segment before ran to its end and this one starts at its own start
    goes_on = (F.lag("t1").over(order) == 1) & (F.col("t0") == 0) & (F.lag("x2").over(order) == F.col("x1")) & (F.lag("y2").over(order) == F.col("y1"))
    cut = cut.withColumn("opens", (~F.coalesce(goes_on, F.lit(False))).cast("long")).withColumn("parts", F.sum("opens").over(Window.partitionBy("way_id")))
    at = lambda c, t: (F.col(f"{c}1") + F.col(t) * (F.col(f"{c}2") - F.col(f"{c}1")))
    one = cut.where("parts = 1")
    ends = one.select("way_id", "seq", F.inline(F.array(F.struct(F.lit(0).alias("k"), at("x", "t0").alias("x"), at("y", "t0").alias("y")), F.struct(F.lit(1).alias("k"), at("x", "t1").alias("x"), at("y", "t1").alias("y")))))
    step = Window.partitionBy("way_id").orderBy("seq", "k")
    kept = ends.withColumn("first", F.row_number().over(step) == 1).where("first OR k = 1")
    found = kept.select("way_id", (F.row_number().over(step) - 1).cast("long").alias("seq"), "x", "y")
    parts = cut.groupBy("way_id").agg(F.max("parts").alias("parts"))
    rejected = lines.select("way_id").distinct().join(parts, "way_id", "left").select("way_id", F.coalesce("parts", F.lit(0)).cast("long").alias("parts")).where("parts <> 1")
    return found, rejected


def fitted_areas(rings: DataFrame, low: float, high: float, angle: float = 0, centre: tuple[float, float] = (0, 0), shift: tuple[float, float] = (0, 0)) -> DataFrame:
    """(feature_id, seq, x, y): closed convex rings (feature_id, seq, x, y) turned, shifted and cut to the square low..high; those outside go.

    A convex ring stays one part under the cut by four half-planes; the ring of a feature is one row on the way.
    """
    x, y = turned(F.col("x"), F.col("y"), angle, centre, shift)
    placed = rings.select("feature_id", F.struct("seq", x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(0.0).alias("z")).alias("p"))
    whole = placed.groupBy("feature_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    polygon = F.transform(F.slice("p", F.lit(1), F.size("p") - 1), lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"), q["z"].alias("z")))
    cut = whole.select("feature_id", polygon.alias("p"))
    for c in "xy":
        for side in (lambda q, c=c: q[c] - low, lambda q, c=c: high - q[c]):
            cut = cut.select("feature_id", clipped(F.col("p"), side).alias("p"))
    area = F.aggregate(F.zip_with("p", F.concat(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))), F.slice("p", 1, 1)), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)
    closed = cut.where(F.size("p") >= 3).where(F.abs(area) > 1e-9).select("feature_id", F.posexplode(F.concat("p", F.slice("p", 1, 1))).alias("seq", "q"))
    return closed.select("feature_id", F.col("seq").cast("long").alias("seq"), "q.x", "q.y")
