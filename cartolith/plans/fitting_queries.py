"""Queries over turned grids and fitted objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolith.operators import fitting as T
from cartolith.plans.fixtures import Register
from cartolith.plans.raster_queries import extent

query = Register()
QUERIES, SQL = query.queries, query.sql


@query("RAS_02_rotated_grid", """WITH m AS (SELECT (max(x) + 1) // 2 AS cx, (max(y) + 1) // 2 AS cy FROM {dem}),
t AS (SELECT a.range AS y, b.range AS x, round(cos(radians(30e0)) * (b.range - 20) - sin(radians(30e0)) * (a.range - 40) + cx, 9) AS sx, round(sin(radians(30e0)) * (b.range - 20) + cos(radians(30e0)) * (a.range - 40) + cy, 9) AS sy FROM range(80) a, range(40) b, m),
n AS (SELECT t.y, t.x, CAST(floor(sy) AS BIGINT) + i.range AS py, CAST(floor(sx) AS BIGINT) + j.range AS px, CASE i.range WHEN 0 THEN 1 - (sy - floor(sy)) ELSE sy - floor(sy) END * CASE j.range WHEN 0 THEN 1 - (sx - floor(sx)) ELSE sx - floor(sx) END AS w FROM t, range(2) i, range(2) j)
SELECT n.y, n.x, round(sum(coalesce(v, 0) * w), 3) AS v FROM n LEFT JOIN {dem} d ON d.y = py AND d.x = px GROUP BY n.y, n.x""")
def _(v):
    return T.rotated_grid(v("dem"), 30, *extent(v), 40, 80).select("y", "x", F.round("v", 3).alias("v"))


@query("POLY_11_fitted_areas", "SELECT feature_id, round(CAST((least(x0 + w, 3000) - greatest(x0, 1000)) * (least(y0 + h, 3000) - greatest(y0, 1000)) AS DOUBLE), 3) AS area FROM {rect} WHERE x0 < 3000 AND x0 + w > 1000 AND y0 < 3000 AND y0 + h > 1000")
def _(v):
    """Areas of the rectangles inside the square 1000..3000, after a shift there and back."""
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h")
    corner = lambda k, x, y: F.struct(F.lit(k).alias("seq"), x.alias("x"), y.alias("y"))
    rings = v("rect").select("feature_id", F.inline(F.array(corner(0, x0, y0), corner(1, x1, y0), corner(2, x1, y1), corner(3, x0, y1), corner(4, x0, y0))))
    found = T.fitted_areas(rings, 0, 2000, shift=(-1000, -1000))
    ahead = lambda c: F.expr(f"lead({c}) OVER (PARTITION BY feature_id ORDER BY seq)")
    edges = found.withColumn("x2", ahead("x")).withColumn("y2", ahead("y")).where("x2 IS NOT NULL")
    return edges.groupBy("feature_id").agg(F.round(F.abs(F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y"))) / 2, 3).alias("area"))


@query("POLY_11_fitted_lines")
def _(v):
    """Lines turned by 30 degrees about the frame's centre and cut to its inner half, and the parts of those that do not fit."""
    found, rejected = T.fitted_lines(v("way_pt"), 1024, 3072, 30, (2048, 2048))
    counts = found.groupBy("way_id").agg(F.count("*").alias("vertices"), F.round(F.sum("x"), 3).alias("sx"), F.round(F.sum("y"), 3).alias("sy"))
    return counts.withColumn("parts", F.lit(1).cast("long")).unionByName(rejected, allowMissingColumns=True)
