"""Queries of the whole jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cartolith.operators import areas as A
from cartolith.operators import cells as C
from cartolith.operators import jobs as J
from cartolith.operators import soil as S
from cartolith.plans.area_queries import areas, beds, covered, obstacles, roads
from cartolith.plans.cell_queries import GRID, LAYERED, LAYERS, grid, layered
from cartolith.plans.feature_queries import KINDS, wanted
from cartolith.plans.fixtures import Register
from cartolith.plans.network_queries import LABELS
from cartolith.plans.raster_queries import extent
from cartolith.plans.road_queries import on_grid
from cartolith.plans.terrain_queries import WATER

query = Register()
QUERIES, SQL = query.queries, query.sql

RESIZED = """m AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM {dem}), t AS (SELECT a.range AS ty, b.range AS tx, (a.range + 5e-1) * (h / 128e0) - 5e-1 AS ay, (b.range + 5e-1) * (w / 128e0) - 5e-1 AS ax, w, h FROM range(128) a, range(128) b, m),
n AS (SELECT ty, tx, greatest(0, least(h - 1, CAST(floor(ay) AS BIGINT) + i.range)) AS y, greatest(0, least(w - 1, CAST(floor(ax) AS BIGINT) + j.range)) AS x, CASE i.range WHEN 0 THEN 1 - (ay - floor(ay)) ELSE ay - floor(ay) END * CASE j.range WHEN 0 THEN 1 - (ax - floor(ax)) ELSE ax - floor(ax) END AS k FROM t, range(2) i, range(2) j),
r AS (SELECT ty AS y, tx AS x, sum(v * k) AS v FROM n JOIN {dem} USING (y, x) GROUP BY ty, tx)"""


@query("RAS_01_resize_linear", f"WITH {RESIZED} SELECT y, x, round(v, 5) AS v FROM r")
def _(v):
    return S.resized_linear(v("dem"), *extent(v), 128, 128).select("y", "x", F.round("v", 5).alias("v"))


@query("JOB_02_elevation", f"""WITH {RESIZED}, a AS (SELECT y, x, v * 2e0 - (SELECT min(v * 2e0) FROM r) + 120 AS v FROM r), s AS (SELECT ceil(greatest(255, max(v) + 10)) AS s FROM a), u AS (SELECT y, x, CAST(floor(greatest(0e0, least(65535e0, v * 65535 / s))) AS BIGINT) AS v FROM a, s),
o AS (SELECT y, x, i.range AS dy, j.range AS dx, abs(y + i.range) AS sy, abs(x + j.range) AS sx FROM u, range(-2, 3) i, range(-2, 3) j), w AS (SELECT range AS d, exp(-range * range / 200e0) / (SELECT sum(exp(-range * range / 200e0)) FROM range(-2, 3)) AS w FROM range(-2, 3))
SELECT o.y, o.x, round(sum(u.v * p.w * q.w), 3) AS v FROM o JOIN w p ON p.d = dy JOIN w q ON q.d = dx JOIN u ON u.y = CASE WHEN sy > 127 THEN 254 - sy ELSE sy END AND u.x = CASE WHEN sx > 127 THEN 254 - sx ELSE sx END GROUP BY o.y, o.x""")
def _(v):
    grid, _ = J.elevation(v("dem"), *extent(v), 128, multiplier=2.0, plateau=100, depth=20, blur=5)
    return grid.select("y", "x", F.round("v", 3).alias("v"))


@query("JOB_03_lowered_water", f"""WITH {WATER}, f AS (SELECT y, x, d2 > 0 AS water, 1 - exp(-sqrt(d2) / 26e-1) AS f FROM d), p AS (SELECT quantile_cont(f, 0.95) FILTER (water) AS top FROM f),
s AS (SELECT y, x, water, greatest(1e-6, least(1 - 1e-6, CASE WHEN water AND top > 1e-6 THEN least(1e0, f / top) ELSE f END)) AS s FROM f, p), c AS (SELECT y, x, water, pow(s, 145e-2) / (pow(s, 145e-2) + pow(1 - s, 145e-2)) AS v FROM s),
m AS (SELECT max(x) AS mx, max(y) AS my FROM c), o AS (SELECT y, x, water, a.range AS dx, b.range AS dy, abs(x + a.range) AS sx, abs(y + b.range) AS sy FROM c, range(-1, 2) a, range(-1, 2) b),
k AS (SELECT o.*, CASE WHEN sx > mx THEN 2 * mx - sx ELSE sx END AS tx, CASE WHEN sy > my THEN 2 * my - sy ELSE sy END AS ty FROM o, m),
g AS (SELECT k.y, k.x, CASE WHEN any_value(k.water) THEN sum(c.v * CASE dx WHEN 0 THEN 5e-1 ELSE 25e-2 END * CASE dy WHEN 0 THEN 5e-1 ELSE 25e-2 END) ELSE 0 END AS f FROM k JOIN c ON c.x = tx AND c.y = ty GROUP BY k.y, k.x)
SELECT y, x, round(CASE WHEN v > 50000 THEN greatest(0, least(65535, v - f * 1028)) ELSE v END, 2) AS v FROM {{dem}} JOIN g USING (y, x)""")
def _(v):
    grid, _ = J.lowered_water(v("dem"), v("dem").where("v > 50000").select("y", "x"), 4.0, 257.0, 4, 4.0, [0.25, 0.5, 0.25], *extent(v))
    return grid.select("y", "x", F.round("v", 2).alias("v"))


@query("JOB_03_water_surfaces")
def _(v):
    found = J.lowered_water(v("dem"), v("dem").where("v > 50000").select("y", "x"), 4.0, 257.0, 4, 4.0, [0.25, 0.5, 0.25], *extent(v))[1]
    return found.select("part", "cells", F.round("z", 3).alias("z"))


def footprints(v):
    """Every customer's footprint as a square of five cells on the elevation grid."""
    at = F.array(*[F.lit(k) for k in range(5)])
    rows = v("footprint").select("footprint_id", (F.col("x") % 60).alias("x0"), (F.col("y") % 496).alias("y0"))
    return rows.withColumn("dx", F.explode(at)).withColumn("dy", F.explode(at)).select("footprint_id", (F.col("y0") + F.col("dy")).alias("y"), (F.col("x0") + F.col("dx")).alias("x"))


FOOT = "(SELECT footprint_id, y % 496 + j.range AS y, x % 60 + i.range AS x FROM {footprint}, range(5) i, range(5) j)"


@query("JOB_04_foundations", f"WITH f AS {FOOT}, m AS (SELECT footprint_id, round_even(avg(v), 0) AS z FROM f JOIN {{dem}} USING (y, x) GROUP BY footprint_id), t AS (SELECT y, x, max(footprint_id) AS footprint_id FROM f GROUP BY y, x) SELECT y, x, CAST(coalesce(z, v) AS DOUBLE) AS v FROM {{dem}} LEFT JOIN (SELECT y, x, z FROM t JOIN m USING (footprint_id)) USING (y, x)")
def _(v):
    return J.foundations(v("dem"), footprints(v))


@query("JOB_04_finished_terrain")
def _(v):
    """Cells of the centre with foundations and road beds, and the area of the mesh around it."""
    _, centre, mesh = J.finished_terrain(v("dem"), footprints(v), on_grid(v), *extent(v), 20)
    double = F.abs((F.col("x2") - F.col("x1")) * (F.col("y3") - F.col("y1")) - (F.col("y2") - F.col("y1")) * (F.col("x3") - F.col("x1")))
    area = mesh.agg(F.round(F.sum(double / 2), 3).alias("area"), F.count("*").alias("faces"))
    return centre.agg(F.count("*").alias("cells"), F.round(F.sum("v"), 1).alias("total")).crossJoin(F.broadcast(area))


@query("JOB_05_property_grids")
def _(v):
    """Farmlands are the farmland rectangles on the whole frame; cover, water and indoor cells come from the others by their id."""
    cells = C.fill_rectangles(v("rect")).select("feature_id", "status", "y", "x")
    other = cells.where("status = 'O'")
    cover = other.select((F.col("feature_id") % 3).alias("layer_no"), (1 + F.col("feature_id") % 3).alias("code"), "y", "x")
    found = J.property_grids(cells.where("status = 'F'").withColumnRenamed("feature_id", "farmland_id"), cover, other.where("feature_id % 5 = 0"), other.where("feature_id % 7 = 0"), 4096, 4096, 200, 3, least=10, most=60)
    return found.groupBy("grid", "v").agg(F.count("*").alias("cells"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


@query("JOB_07_road_network")
def _(v):
    lines = roads(v)
    textures = v("way_tag").where("k = 'highway'").select("way_id", F.col("v").alias("texture"))
    shared = v("way_node").join(lines.select("way_id").distinct(), "way_id", "left_semi").select("way_id", "node_id").distinct()
    low = shared.where("node_id % 8 = 0").groupBy("node_id").agg(F.min("way_id").alias("b"))
    links = shared.join(low, "node_id").select(F.col("way_id").alias("a"), "b").where("a <> b").distinct()
    _, surface, samples = J.road_network(lines, textures, links, 2)
    counts = samples.groupBy("texture", "component").agg(F.count("*").alias("samples"))
    return surface.groupBy("texture", "component").agg(F.count("*").alias("cells"), F.sum("x").alias("sx"), F.sum("y").alias("sy")).join(counts, ["texture", "component"])


@query("JOB_08_placed_buildings", f"""WITH {KINDS}, q AS (SELECT a.footprint_id, b.ord, least(a.width, b.width) / CAST(greatest(a.width, b.width) AS DOUBLE) AS pw, least(a.depth, b.depth) / CAST(greatest(a.depth, b.depth) AS DOUBLE) AS pd, least(a.width, b.depth) / CAST(greatest(a.width, b.depth) AS DOUBLE) AS tw, least(a.depth, b.width) / CAST(greatest(a.depth, b.width) AS DOUBLE) AS td
 FROM {{footprint}} a JOIN kinds USING (kind) JOIN {{building}} b ON b.category = kinds.category),
p AS (SELECT footprint_id, ord, CASE WHEN pw >= 1 - 3e-1 AND pd >= 1 - 3e-1 THEN 100 + 80 * (pw + pd) / 2 END AS p, CASE WHEN tw >= 1 - 3e-1 AND td >= 1 - 3e-1 THEN 100 + 80 * (tw + td) / 2 END AS t FROM q),
b AS (SELECT footprint_id, ord, coalesce(t, 0) > coalesce(p, 0) AS turned, row_number() OVER (PARTITION BY footprint_id ORDER BY greatest(coalesce(p, 0), coalesce(t, 0)) DESC, ord) AS no FROM p WHERE p IS NOT NULL OR t IS NOT NULL),
c AS (SELECT footprint_id, ord, turned, 65999 + row_number() OVER (ORDER BY footprint_id) AS node_id, 64999 + dense_rank() OVER (ORDER BY ord) AS file_id FROM b WHERE no = 1)
SELECT c.footprint_id, node_id, file_id, ord, f.x // 40 AS x, f.y // 7 AS y, coalesce(d.v, 200) AS z, (f.footprint_id * 30 + CASE WHEN turned THEN 90 ELSE 0 END) % 360 AS yaw FROM c JOIN {{footprint}} f USING (footprint_id) LEFT JOIN {{dem}} d ON d.x = f.x // 40 AND d.y = f.y // 7""")
def _(v):
    own = wanted(v).withColumn("x", F.expr("x div 40")).withColumn("y", F.expr("y div 7"))
    own = own.select("footprint_id", "x", "y", "width", "depth", (F.col("footprint_id") * 30 % 360).alias("angle"), "category")
    legend = v.spark.createDataFrame([(1, "farmyard"), (2, "industrial")], "class long, category string")
    return J.placed_buildings(own, v("soil"), legend, v("dem"), v("building"), 0.3)


@query("JOB_09_power_network")
def _(v):
    """Poles and towers with their headings, and the wires between them, by pole."""
    wire = lambda side, height: F.struct(F.lit(side).alias("side"), F.lit(height).alias("height"))
    kinds = v.spark.range(3).select((F.col("id") + 1).alias("ord"), F.get(F.array(F.lit("pole"), F.lit("tower"), F.lit("default")), F.col("id").cast("int")).alias("category"), F.when(F.col("id") == 2, F.array().cast("array<struct<side:double,height:double>>")).otherwise(F.array(wire(-2.0, 10.0), wire(2.0, 10.0))).alias("connectors"), (F.col("id") != 1).alias("align"), (F.col("id") == 0).alias("snap"))
    poles = v("node").join(v("node_tag"), "node_id").select(F.col("node_id").alias("pole"), "x", "y", F.col("v").alias("category"))
    headed, wires = J.power_network(poles, kinds, v("way_pt"), roads(v))
    sums = wires.groupBy(F.col("wire_id.a").alias("pole")).agg(F.count("*").alias("points"), F.round(F.sum("y"), 3).alias("height"))
    return headed.select("pole", F.round("x", 3).alias("x"), F.round("z", 3).alias("z"), F.round("yaw", 3).alias("yaw")).join(sums, "pole", "left")


TREE = "(x * 73856093 + y * 19349663 + 5 + {s}) % 2147483647 * 48271 % 2147483647"


@query("JOB_12_background_trees", f"""WITH l AS (SELECT y, x, (x * 73856093 + y * 19349663) % 2147483647 % 4 AS asset FROM {{mask}} WHERE y % 4 = 0 AND x % 4 = 0 AND NOT (abs(y - 250) <= 20 AND abs(x - 32) <= 20)),
t AS (SELECT y, x, k.range AS try, y + {TREE.format(s="k.range * 7919")} % 7 - 3 AS jy, x + {TREE.format(s="k.range * 104729")} % 7 - 3 AS jx FROM l, range(1, 5) k),
f AS (SELECT t.y, t.x, arg_min(t.jy, try) AS jy, arg_min(t.jx, try) AS jx FROM t JOIN {{mask}} m ON m.y = t.jy AND m.x = t.jx GROUP BY t.y, t.x)
SELECT l.y, l.x, asset, coalesce(f.jy, l.y) AS jy, coalesce(f.jx, l.x) AS jx, coalesce(d.v, 200) AS z, round(8e-1 + {TREE.format(s="31").replace("x *", "l.x *").replace("y *", "l.y *")} % 401 / 1000e0, 4) AS scale FROM l LEFT JOIN f USING (y, x) LEFT JOIN {{dem}} d ON d.y = coalesce(f.jy, l.y) AND d.x = coalesce(f.jx, l.x)""")
def _(v):
    trees, _ = J.background_trees(v("mask"), v("dem"), 4, 4, *extent(v), 20, 5)
    return trees.select("y", "x", "asset", "jy", "jx", "z", F.round("scale", 4).alias("scale"))


@query("RAS_18_local_wetness")
def _(v):
    width, height = extent(v)
    heights = S.unit(v("dem"), v=F.col("v").cast("double"))
    slopes = S.signals(heights, width, height)
    return S.local_wetness(heights, slopes, width, height).select("y", "x", F.round("wet", 5).alias("wet"))


@query("RAS_17_soil_classes")
def _(v):
    width, height = extent(v)
    return S.classified(S.unit(v("dem"), v=F.col("v").cast("double")), width, height, 4)


@query("JOB_06_soil_map")
def _(v):
    """Shares of the soil classes of the first grid that has cells, on a map of 256 cells a side."""
    none = v("dem").where("v < 0")
    return S.distribution(S.soil_map([none, v("dem")], 256))


@query("JOB_01_land_cover", f"""WITH {LAYERED}, {GRID}, o AS (SELECT x, y, min_by(layer, rank) AS layer FROM l GROUP BY x, y), c AS (SELECT x, y, coalesce(layer, 'base') AS layer FROM grid LEFT JOIN o USING (x, y)),
m AS (SELECT x, y, CASE WHEN layer = 'farmland' THEN 'field' WHEN layer = 'forest' AND (x < 10 OR y < 10 OR x >= 260 OR y >= 260) THEN 'base' ELSE layer END AS layer FROM c)
SELECT layer, CASE WHEN layer = 'field' THEN (x * 73856093 + y * 19349663 + 7) % 2147483647 % 3 ELSE 0 END AS part, count(*) AS cells, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy FROM m GROUP BY ALL""")
def _(v):
    found = J.land_cover(layered(v), LAYERS, grid(v), 270, "base", {"farmland": "field"}, {"forest": 10}, {"field": 3}, 7)
    return found.groupBy("layer", "part").agg(F.count("*").alias("cells"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


POINTS = f"""{LABELS}, c AS (SELECT *, avg(y) OVER w AS cy, avg(x) OVER w AS cx, count(*) OVER w AS n, row_number() OVER (PARTITION BY label ORDER BY y, x) - 1 AS k FROM l WINDOW w AS (PARTITION BY label)),
d AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round((y - cy) * (y - cy) + (x - cx) * (x - cx), 6), y, x) AS nearest FROM c), p AS (SELECT y, x, CASE WHEN nearest = 1 THEN 'centre' ELSE 'step' END AS kind, row_number() OVER (ORDER BY y, x) AS tree_id FROM d WHERE nearest = 1 OR (n > 5 AND k % 5 = 0))"""


@query("JOB_10_forest_points", f"{POINTS} SELECT tree_id, p.y, p.x, kind, ['ash', 'birch', 'oak'][CAST((tree_id * 73856093 + 3) % 2147483647 % 3 + 1 AS INT)] AS asset, coalesce(v, 200) AS z FROM p LEFT JOIN {{dem}} d ON d.y = p.y AND d.x = p.x")
def _(v):
    kinds = v.spark.createDataFrame([("tree", "birch"), ("tree", "ash"), ("tree", "oak")], "class string, asset string")
    return J.forest_points(v("mask"), v("dem"), kinds, 5, seed=3)


@query("JOB_11_prepared_extract")
def _(v):
    """Rows of the tables of a published extract: one region's relations, fields cut by roads, forests merged."""
    context = v.spark.sparkContext
    folder = f"{context.getConf().get('spark.checkpoint.dir') or context.getCheckpointDir()}/extract-{uuid.uuid4().hex}"
    settings = {"field": A.CleanUp(split=True, padding=1, min_cells=20), "forest": A.CleanUp(merge=True)}
    targets = covered(v).withColumn("usage", F.when(F.col("group") == "F", "field").otherwise("forest"))
    tables = J.prepared_extract(v("tile_extract"), v("relation_member"), v("way_node"), v("region").where("r_regionkey = 1").select((F.col("r_regionkey") + 2000000).alias("rel_id")), targets, settings, beds(v, 2), obstacles(v))
    J.published(folder, tables)
    counts = [J.current(v.spark, folder, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name in tables]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])
