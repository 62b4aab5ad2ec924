"""Queries over elevation, class and mask grids, and the tables derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolith.operators import raster as R
from cartolith.plans.fixtures import Register

query = Register()
QUERIES, SQL = query.queries, query.sql
NEAR = "n AS (SELECT c.y, c.x, o.v, o.y - c.y AS dy, o.x - c.x AS dx FROM {dem} c JOIN {dem} o ON o.y BETWEEN c.y - 1 AND c.y + 1 AND o.x BETWEEN c.x - 1 AND c.x + 1)"


def extent(v):
    """(width, height) of the elevation grid."""
    return R.extent(v("dem"))


@query("AGG_07_grid_profile", "SELECT min(v) AS lo, max(v) AS hi, max(v) - min(v) AS spread, count(*) AS n, count(*) FILTER (v <> 0) AS n_set FROM {dem}")
def _(v):
    return R.profile(v("dem"))


@query("SRC_08_elevation_checks", "SELECT count(*) AS n FROM {dem}")
def _(v):
    return R.checked(v("dem"))


@query("AGG_08_height_scale", "SELECT scale, round(65535 / scale, 6) AS z_factor, round(scale / 255, 6) AS multiplier FROM (SELECT ceil(greatest(255e0, max(v) + 50)) AS scale FROM {dem})")
def _(v):
    return R.height_scale(v("dem"), 255.0, 50.0).select("scale", F.round("z_factor", 6).alias("z_factor"), F.round("multiplier", 6).alias("multiplier"))


@query("SRC_09_custom_elevation", "SELECT 255e0 AS scale, 257e0 AS z_factor, 1e0 AS multiplier")
def _(v):
    return R.height_scale(v("dem"), 255.0, 0.0, adjust=False)


@query("AGG_09_raise_and_normalise", "SELECT y, x, CAST(trunc(greatest(0e0, least(65535e0, (v - lo + 500 + 20) * 65535e0 / 200000))) AS BIGINT) AS v FROM {dem}, (SELECT min(v) AS lo FROM {dem})")
def _(v):
    return R.normalised(R.raised(v("dem"), 500, 20), 200000.0)


@query("AGG_10_unit_scale", "SELECT y, x, round((v - lo) / CAST(hi - lo AS DOUBLE), 6) AS u FROM {dem}, (SELECT min(v) AS lo, max(v) AS hi FROM {dem})")
def _(v):
    return R.unit(v("dem")).select("y", "x", F.round("u", 6).alias("u"))


@query("AGG_11_quantiles", "SELECT round(quantile_cont(v, 0.25), 4) AS q25, round(quantile_cont(v, 0.95), 4) AS q95 FROM {dem} WHERE v > 60000")
def _(v):
    return v("dem").where("v > 60000").agg(F.round(F.percentile("v", 0.25), 4).alias("q25"), F.round(F.percentile("v", 0.95), 4).alias("q95"))


@query("AGG_14_class_share", "SELECT class, count(*) AS n, round(count(*) / CAST(any_value(total) AS DOUBLE), 6) AS share FROM {soil}, (SELECT count(*) AS total FROM {soil}) GROUP BY class")
def _(v):
    return R.shares(v("soil"))


@query("AGG_15_step_by_limit", "SELECT count(*) AS n, greatest(1, (count(*) + 999) // 1000) AS step FROM {mask}")
def _(v):
    return v("mask").agg(F.count("*").alias("n")).select("n", F.greatest(F.lit(1), F.expr("(n + 999) div 1000")).alias("step"))


@query("AGG_16_nonzero_bounds", "SELECT min(x) AS left, 63 - max(x) AS right, min(y) AS top, 499 - max(y) AS bottom FROM {mask}")
def _(v):
    width, height = extent(v)
    return v("mask").agg(F.min("x").alias("left"), (width - 1 - F.max("x")).alias("right"), F.min("y").alias("top"), (height - 1 - F.max("y")).alias("bottom"))


@query("AGG_17_extremes_under_mask", "WITH u AS (SELECT * FROM {dem} WHERE v > 68000), a AS (SELECT v AS lo, y AS lo_y, x AS lo_x FROM u ORDER BY v, y, x LIMIT 1), b AS (SELECT v AS hi, y AS hi_y, x AS hi_x FROM u ORDER BY v DESC, y, x LIMIT 1) SELECT * FROM a, b")
def _(v):
    return R.extremes(v("dem"), v("mask"))


@query("AGG_18_mask_centroid", "SELECT class, CAST(trunc(avg(x)) AS BIGINT) AS cx, CAST(trunc(avg(y)) AS BIGINT) AS cy FROM {soil} GROUP BY class")
def _(v):
    return v("soil").groupBy("class").agg(F.avg("x").cast("long").alias("cx"), F.avg("y").cast("long").alias("cy"))


@query("AGG_29_local_majority", "WITH c AS (SELECT c.y, c.x, o.class, count(*) AS n FROM {soil} c JOIN {soil} o ON o.y BETWEEN c.y - 1 AND c.y + 1 AND o.x BETWEEN c.x - 1 AND c.x + 1 GROUP BY ALL) SELECT y, x, arg_max(class, (n, -class)) AS class FROM c GROUP BY y, x")
def _(v):
    return R.majority(v("soil"), 1, *extent(v))


@query("AGG_34_elevation_metres", "SELECT CAST(trunc(max(v) / 255e0) AS BIGINT) AS hi, CAST(trunc(min(v) / 255e0) AS BIGINT) AS lo FROM {dem}")
def _(v):
    return v("dem").agg((F.max("v") / 255.0).cast("long").alias("hi"), (F.min("v") / 255.0).cast("long").alias("lo"))


@query("AGG_12_footprint_levelling", "SELECT (y // 10) * 4 + x // 16 AS f, CAST(round_even(avg(v), 0) AS BIGINT) AS level FROM {dem} GROUP BY 1")
def _(v):
    return v("dem").groupBy(F.expr("(y div 10) * 4 + x div 16").alias("f")).agg(F.bround(F.avg("v")).cast("long").alias("level"))


@query("AGG_13_station_window_mean", "SELECT s.y AS station, round(avg(d.v), 4) AS v FROM (SELECT DISTINCT y FROM {dem} WHERE y % 50 = 0) s JOIN {dem} d ON d.y BETWEEN s.y - 5 AND s.y + 5 AND d.x BETWEEN 27 AND 37 GROUP BY s.y")
def _(v):
    stations = v.spark.range(0, extent(v)[1], 50).select(F.col("id").alias("station"), F.explode(F.sequence(F.col("id") - 5, F.col("id") + 5)).alias("y"))
    return v("dem").where("x BETWEEN 27 AND 37").join(F.broadcast(stations), "y").groupBy("station").agg(F.round(F.avg("v"), 4).alias("v"))


@query("RAS_01_resize_nearest", "SELECT y.range AS y, x.range AS x, v FROM range(250) y, range(96) x JOIN {dem} d ON d.y = y.range * 500 // 250 AND d.x = x.range * 64 // 96")
def _(v):
    return R.resized_nearest(v("dem"), *extent(v), 96, 250)


@query("RAS_01_resize_area", "SELECT y // 4 AS y, x // 4 AS x, round(avg(v), 4) AS v FROM {dem} GROUP BY 1, 2")
def _(v):
    return R.area_average(v("dem"), 4).withColumn("v", F.round("v", 4))


@query("RAS_05_blur", "WITH k AS (SELECT * FROM (VALUES (-1, 0.25e0), (0, 0.5e0), (1, 0.25e0)) k(o, w)), a AS (SELECT t.y, t.x, sum(s.v * w) AS v FROM {dem} t, k JOIN {dem} s ON s.y = t.y AND s.x = CASE WHEN t.x + o < 0 THEN -(t.x + o) WHEN t.x + o > 63 THEN 126 - t.x - o ELSE t.x + o END GROUP BY t.y, t.x) SELECT t.y, t.x, round(sum(s.v * w), 4) AS v FROM a t, k JOIN a s ON s.x = t.x AND s.y = CASE WHEN t.y + o < 0 THEN -(t.y + o) WHEN t.y + o > 499 THEN 998 - t.y - o ELSE t.y + o END GROUP BY t.y, t.x")
def _(v):
    return R.blurred(v("dem"), *extent(v), [0.25, 0.5, 0.25]).select("y", "x", F.round("v", 4).alias("v"))


@query("RAS_07_masked_replace", "SELECT y, x, CASE WHEN v > 68000 THEN 0 ELSE v END AS v FROM {dem}")
def _(v):
    return R.masked_replace(v("dem"), v("dem").withColumn("v", F.lit(0).cast("long")), v("mask"))


@query("RAS_10_gradient", f"WITH {NEAR} SELECT y, x, CAST(pow(sum(v * dx * CASE WHEN dy = 0 THEN 2 ELSE 1 END), 2) + pow(sum(v * dy * CASE WHEN dx = 0 THEN 2 ELSE 1 END), 2) AS BIGINT) AS g2 FROM n GROUP BY y, x HAVING count(*) = 9")
def _(v):
    return R.gradient(v("dem"), *extent(v))


@query("RAS_10_relief", f"WITH {NEAR} SELECT y, x, max(v) - min(v) AS relief FROM n GROUP BY y, x")
def _(v):
    return R.relief(v("dem"), 1, *extent(v))


@query("RAS_13_lower_water", "SELECT y, x, greatest(0, CASE WHEN v > 68000 THEN v - 2000 ELSE v END) AS v FROM {dem}")
def _(v):
    lowered = v("dem").withColumn("v", F.col("v") - 2000)
    return R.masked_replace(v("dem"), lowered, v("mask")).withColumn("v", F.greatest(F.lit(0), F.col("v")))


@query("RAS_15_components", "WITH RECURSIVE m AS (SELECT y, x, y * 1048576 + x AS id FROM {mask}), e AS (SELECT a.id, b.id AS nb FROM m a JOIN m b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1), r AS (SELECT id, id AS label FROM m UNION SELECT e.nb, r.label FROM r JOIN e ON e.id = r.id WHERE r.label < e.nb) SELECT id // 1048576 AS y, id % 1048576 AS x, min(label) AS label FROM r GROUP BY id")
def _(v):
    return R.components(v("mask"))


@query("AGG_28_component_statistics", "WITH RECURSIVE m AS (SELECT y, x, y * 1048576 + x AS id FROM {mask}), e AS (SELECT a.id, b.id AS nb FROM m a JOIN m b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1), r AS (SELECT id, id AS label FROM m UNION SELECT e.nb, r.label FROM r JOIN e ON e.id = r.id WHERE r.label < e.nb), l AS (SELECT id // 1048576 AS y, id % 1048576 AS x, min(label) AS label FROM r GROUP BY id) SELECT label, count(*) AS area, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM l GROUP BY label")
def _(v):
    return R.components(v("mask")).groupBy("label").agg(F.count("*").alias("area"), F.round(F.avg("x"), 6).alias("cx"), F.round(F.avg("y"), 6).alias("cy"))


@query("RAS_19_centre_cut", "SELECT y - 150 AS y, x - 16 AS x, v FROM {dem} WHERE x BETWEEN 16 AND 47 AND y BETWEEN 150 AND 349")
def _(v):
    return R.centre_cut(v("dem"), *extent(v), 16, 100)


@query("RAS_20_environment_grid", "SELECT y, x, (CASE class WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END + CASE WHEN v > 68000 THEN 8 ELSE 0 END) % 256 AS code FROM {soil} JOIN {dem} USING (y, x)")
def _(v):
    codes = v("soil").withColumn("code", F.when(F.col("class") == 0, 1).when(F.col("class") == 1, 2).otherwise(3))
    wet = v("mask").withColumn("wet", F.lit(8))
    return codes.join(wet, ["y", "x"], "left").select("y", "x", ((F.col("code") + F.coalesce("wet", F.lit(0))) % 256).alias("code"))


@query("RAS_21_indoor_grid", "SELECT DISTINCT y // 2 AS y, x // 2 AS x, 1 AS v FROM {soil} WHERE class = 2")
def _(v):
    return v("soil").where("class = 2").select(F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x")).distinct().withColumn("v", F.lit(1))


@query("RAS_25_overview", "SELECT y // 8 AS y, x // 8 AS x, CAST(sum(class * 60) % 256 AS BIGINT) AS v FROM {soil} GROUP BY 1, 2")
def _(v):
    return v("soil").groupBy(F.expr("y div 8").alias("y"), F.expr("x div 8").alias("x")).agg((F.sum(F.col("class") * 60) % 256).alias("v"))


@query("RAS_27_validate_grid", "SELECT count(*) = 32000 AND min(v) >= 0 AS ok FROM {dem}")
def _(v):
    width, height = extent(v)
    return v("dem").agg(((F.count("*") == width * height) & (F.min("v") >= 0)).alias("ok"))


@query("JOIN_12_elevation_at_points", "SELECT footprint_id, round(v * 0.5e0, 4) AS z FROM {footprint} f JOIN {dem} d ON d.x = least(63, f.x // 50) AND d.y = least(499, f.y // 7)")
def _(v):
    points = v("footprint").select("footprint_id", F.expr("x div 50").alias("px"), F.expr("y div 7").alias("py"))
    return R.sampled(v("dem"), points, *extent(v), 0.5).select("footprint_id", F.round("z", 4).alias("z"))


@query("JOIN_13_elevation_with_default", "SELECT footprint_id, coalesce(v, 200) AS z FROM {footprint} f LEFT JOIN {dem} d ON d.x = f.x // 40 AND d.y = f.y // 7")
def _(v):
    points = v("footprint").select("footprint_id", F.expr("x div 40").alias("x"), F.expr("y div 7").alias("y"))
    return points.join(v("dem"), ["y", "x"], "left").select("footprint_id", F.coalesce("v", F.lit(200)).alias("z"))


@query("JOIN_14_category_at_location", "SELECT footprint_id, CASE class WHEN 1 THEN 'farmyard' WHEN 2 THEN 'industrial' WHEN 3 THEN 'commercial' ELSE 'residential' END AS category FROM {footprint} f LEFT JOIN {soil} s ON s.x = f.x // 40 AND s.y = f.y // 7")
def _(v):
    legend = v.spark.createDataFrame([(1, "farmyard"), (2, "industrial"), (3, "commercial")], "class long, category string")
    points = v("footprint").select("footprint_id", F.expr("x div 40").alias("x"), F.expr("y div 7").alias("y"))
    return points.join(v("soil"), ["y", "x"], "left").join(F.broadcast(legend), "class", "left").select("footprint_id", F.coalesce("category", F.lit("residential")).alias("category"))


@query("TOP_06_lattice_sample", "SELECT y, x FROM {mask} WHERE x % 8 = 0 AND y % 8 = 0 AND NOT (abs(x - 32) <= 10 AND abs(y - 250) <= 100)")
def _(v):
    return v("mask").where("x % 8 = 0 AND y % 8 = 0 AND NOT (abs(x - 32) <= 10 AND abs(y - 250) <= 100)").select("y", "x")


@query("MESH_01_vertices", "SELECT (y // 8) * 8 + x // 8 AS vid, x, y, hi - v AS z FROM {dem}, (SELECT max(v) AS hi FROM {dem}) WHERE x % 8 = 0 AND y % 8 = 0")
def _(v):
    return R.mesh(v("dem"), *extent(v), 8)[0]


@query("MESH_01_faces", "SELECT q * 2 + t.range AS fid, a AS v1, CASE WHEN t.range = 0 THEN a + 8 ELSE a + 9 END AS v2, CASE WHEN t.range = 0 THEN a + 9 ELSE a + 1 END AS v3 FROM (SELECT (y // 8) * 8 + x // 8 AS a, (y // 8) * 7 + x // 8 AS q FROM {dem} WHERE x % 8 = 0 AND y % 8 = 0 AND x // 8 < 7 AND y // 8 < 62), range(2) t")
def _(v):
    return R.mesh(v("dem"), *extent(v), 8)[1]


@query("MESH_02_affine", "SELECT (y // 8) * 8 + x // 8 AS vid, round((63 - x) * 2.0e0, 4) AS px, round((499 - y) * 2.0e0, 4) AS py FROM {dem} WHERE x % 8 = 0 AND y % 8 = 0")
def _(v):
    width, height = extent(v)
    return R.mesh(v("dem"), width, height, 8)[0].select("vid", ((width - 1 - F.col("x")) * 2.0).alias("px"), ((height - 1 - F.col("y")) * 2.0).alias("py"))


@query("MESH_03_ground_uv", "SELECT (y // 8) * 8 + x // 8 AS vid, round(x / 56e0, 6) AS u, round(1 - y / 496e0, 6) AS w FROM {dem} WHERE x % 8 = 0 AND y % 8 = 0")
def _(v):
    vertices = R.mesh(v("dem"), *extent(v), 8)[0]
    box = R.with_scalars(vertices, F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return box.select("vid", F.round((F.col("x") - F.col("x0")) / (F.col("x1") - F.col("x0")), 6).alias("u"), F.round(1 - (F.col("y") - F.col("y0")) / (F.col("y1") - F.col("y0")), 6).alias("w"))


@query("AGG_32_mesh_extents", "SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM {dem} WHERE x % 8 = 0 AND y % 8 = 0")
def _(v):
    vertices = R.mesh(v("dem"), *extent(v), 8)[0]
    return vertices.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.round(F.avg("x"), 6).alias("cx"), F.round(F.avg("y"), 6).alias("cy"))


SPANS = "(SELECT node_id AS wire_id, x AS x1, 10 AS y1, y AS z1, x + 30 AS x2, 12 AS y2, y + 40 AS z2 FROM {node})"


@query("MESH_08_sagging_wires", f"SELECT wire_id, k.range AS k, round(x1 + 30 * k.range / 10e0, 5) AS x, round(10 + 2 * k.range / 10e0 - 4 * greatest(0.35e0, least(2e0, 0.03e0 * sqrt(2504e0))) * (k.range / 10e0) * (1 - k.range / 10e0), 5) AS y FROM {SPANS}, range(11) k")
def _(v):
    spans = v("node").selectExpr("node_id AS wire_id", "x AS x1", "10 AS y1", "y AS z1", "x + 30 AS x2", "12 AS y2", "y + 40 AS z2")
    return R.wires(spans).select("wire_id", F.col("k").cast("long").alias("k"), F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query("MESH_07_billboards", "SELECT node_id, c.range AS corner, x + CASE WHEN c.range IN (1, 2) THEN 2 WHEN c.range IN (0, 3) THEN -2 ELSE 0 END AS px, y + CASE WHEN c.range IN (5, 6) THEN 2 WHEN c.range IN (4, 7) THEN -2 ELSE 0 END AS pz FROM {node}, range(8) c")
def _(v):
    corners = [(k, (2 if k in (1, 2) else -2 if k in (0, 3) else 0), (2 if k in (5, 6) else -2 if k in (4, 7) else 0)) for k in range(8)]
    table = F.array(*[F.struct(F.lit(k).cast("long").alias("corner"), F.lit(dx).alias("dx"), F.lit(dz).alias("dz")) for k, dx, dz in corners])
    return v("node").select("node_id", "x", "y", F.explode(table).alias("c")).select("node_id", "c.corner", (F.col("x") + F.col("c.dx")).alias("px"), (F.col("y") + F.col("c.dz")).alias("pz"))
