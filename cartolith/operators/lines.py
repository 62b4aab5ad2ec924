"""Lines as vertex rows (way_id, seq, x, y): lengths, stations, splits, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by_way():
    """The vertices of a line in order."""
    return Window.partitionBy("way_id").orderBy("seq")



def measured(points: DataFrame) -> DataFrame:
    """Segments with x2, y2, length and the distance `start` from the line's first vertex."""
    df = points.withColumn("x2", F.lead("x").over(by_way())).withColumn("y2", F.lead("y").over(by_way())).where("x2 IS NOT NULL")
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    df = df.withColumn("length", F.sqrt((dx * dx + dy * dy).cast("double")))
    return df.withColumn("start", F.sum("length").over(by_way().rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))


def lengths(points: DataFrame) -> DataFrame:
    return measured(points).groupBy("way_id").agg(F.sum("length").alias("length"))


def without_repeats(points: DataFrame) -> DataFrame:
    """Drop vertices equal to the one before."""
    same = (F.lag("x").over(by_way()) == F.col("x")) & (F.lag("y").over(by_way()) == F.col("y"))
    return points.withColumn("same", F.coalesce(same, F.lit(False))).where("NOT same").drop("same")


def stations(points: DataFrame, step: float, keep_last: bool = False) -> DataFrame:
    """(way_id, station, d, x, y) at near-constant spacing: n = max(1, ceil(length / step)) parts.

    With keep_last the spacing is exactly `step` and the last vertex closes the line.
    """
    segs = measured(points)
    total = segs.groupBy("way_id").agg(F.sum("length").alias("total")).where("total > 0")
    n = F.greatest(F.lit(1), F.ceil(F.col("total") / step)).cast("long")
    rows = total.withColumn("n", n).withColumn("station", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    at = F.least(F.col("station") * F.lit(step), F.col("total")) if keep_last else F.col("station") * F.col("total") / F.col("n")
    rows = rows.select("way_id", "station", at.alias("d"))
    # the segment that holds a station: the last one that starts at or before it
    on = segs.where("length > 0").select("way_id", F.col("start").alias("d"), F.struct("seq", "x", "y", "x2", "y2", "length", "start").alias("s"))
    both = rows.select("way_id", "d", F.lit(1).alias("kind"), "station", F.lit(None).cast(on.schema["s"].dataType).alias("s"))
    both = both.unionByName(on.select("way_id", "d", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("station"), "s"))
    order = Window.partitionBy("way_id").orderBy("d", "kind", F.col("s.seq")).rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("g", F.last("s", ignorenulls=True).over(order)).where("kind = 1")
    share = F.least(F.lit(1.0), (F.col("d") - F.col("g.start")) / F.col("g.length"))
    return placed.select("way_id", "station", "d", (F.col("g.x") + share * (F.col("g.x2") - F.col("g.x"))).alias("x"), (F.col("g.y") + share * (F.col("g.y2") - F.col("g.y"))).alias("y"))


def inserted(points: DataFrame, n: int) -> DataFrame:
    """n evenly spaced integer points between neighbours, the last vertex included."""
    nxt = points.withColumn("x2", F.lead("x").over(by_way())).withColumn("y2", F.lead("y").over(by_way()))
    steps = F.when(F.col("x2").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(n)))
    rows = nxt.withColumn("k", F.explode(steps))
    mid = lambda a, b: F.when(F.col(b).isNull(), F.col(a)).otherwise((F.col(a) + (F.col(b) - F.col(a)) * F.col("k") / F.lit(float(n + 1))).cast("long"))
    return rows.select("way_id", "seq", "k", mid("x", "x2").alias("px"), mid("y", "y2").alias("py"))


def perpendiculars(points: DataFrame) -> DataFrame:
    """Unit perpendicular at each vertex from its neighbours' difference (one-sided at the ends)."""
    dx = F.coalesce(F.lead("x").over(by_way()), F.col("x")) - F.coalesce(F.lag("x").over(by_way()), F.col("x"))
    dy = F.coalesce(F.lead("y").over(by_way()), F.col("y")) - F.coalesce(F.lag("y").over(by_way()), F.col("y"))
    rows = points.withColumn("dx", dx.cast("double")).withColumn("dy", dy.cast("double")).withColumn("n", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    return rows.select("way_id", "seq", F.when(F.col("n") > 0, -F.col("dy") / F.col("n")).otherwise(0.0).alias("nx"), F.when(F.col("n") > 0, F.col("dx") / F.col("n")).otherwise(0.0).alias("ny"))


def turns(points: DataFrame, degrees: float, target: float) -> DataFrame:
    """(way_id, sharp, sparse): whether a turn exceeds the angle, or a segment 1.5 times the target length."""
    segs = measured(points).where("length > 0").withColumn("dx", F.col("x2") - F.col("x")).withColumn("dy", F.col("y2") - F.col("y"))
    dot = F.col("dx") * F.lag("dx").over(by_way()) + F.col("dy") * F.lag("dy").over(by_way())
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (F.col("length") * F.lag("length").over(by_way()))))
    segs = segs.withColumn("angle", F.round(F.degrees(F.acos(cosine)), 6))
    return segs.groupBy("way_id").agg(F.coalesce(F.bool_or(F.col("angle") > degrees), F.lit(False)).alias("sharp"), F.bool_or(F.col("length") > 1.5 * target).alias("sparse"))


def parts(points: DataFrame, longest: float) -> DataFrame:
    """(way_id, part, from_d, to_d): equal parts of at most `longest`."""
    total = lengths(points).where("length > 0")
    n = F.greatest(F.lit(1), F.ceil(F.col("length") / longest)).cast("long")
    rows = total.withColumn("n", n).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return rows.select("way_id", "part", (F.col("part") * F.col("length") / F.col("n")).alias("from_d"), ((F.col("part") + 1) * F.col("length") / F.col("n")).alias("to_d"))


def both_directions(points: DataFrame) -> DataFrame:
    """Original and reversed copies of every line."""
    n = F.count("*").over(Window.partitionBy("way_id"))
    rows = points.withColumn("n", n).withColumn("variant", F.explode(F.array(F.lit("original"), F.lit("reversed"))))
    return rows.select("way_id", "variant", F.when(F.col("variant") == "original", F.col("seq")).otherwise(F.col("n") - 1 - F.col("seq")).alias("seq"), "x", "y")


def ring_measures(vertices: DataFrame, key: str) -> DataFrame:
    """(key, area2, perimeter, cx, cy) of closed rings: twice the signed area by the shoelace sum, mean of the ring points truncated."""
    w = Window.partitionBy(key).orderBy("seq")
    df = vertices.withColumn("x2", F.lead("x").over(w)).withColumn("y2", F.lead("y").over(w))
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    return df.groupBy(key).agg(
        F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y")).alias("area2"),
        F.sum(F.sqrt((dx * dx + dy * dy).cast("double"))).alias("perimeter"),
        F.avg("x").cast("long").alias("cx"),
        F.avg("y").cast("long").alias("cy"),
    )


def links(sequences: DataFrame) -> DataFrame:
    """(a, b, radius): successive poles on a line as unordered pairs with the largest radius."""
    nxt = sequences.withColumn("to", F.lead("pole").over(by_way())).where("to IS NOT NULL AND to <> pole")
    return nxt.groupBy(F.least("pole", "to").alias("a"), F.greatest("pole", "to").alias("b")).agg(F.max("radius").alias("radius"))
