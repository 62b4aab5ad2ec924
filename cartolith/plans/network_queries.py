"""Queries over networks, placements, variants and catalogues."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cartolith.operators import cells as C
from cartolith.operators import features as G
from cartolith.operators import lines as L
from cartolith.operators import network as N
from cartolith.operators import raster as R
from cartolith.plans.feature_queries import KINDS, NEAR, wanted
from cartolith.plans.fixtures import Register
from cartolith.plans.raster_queries import extent

query = Register()
QUERIES, SQL = query.queries, query.sql

LINKS = "k AS (SELECT DISTINCT least(pole, nxt) AS a, greatest(pole, nxt) AS b FROM (SELECT node_id AS pole, lead(node_id) OVER (PARTITION BY way_id ORDER BY seq) AS nxt FROM {way_node}) WHERE nxt IS NOT NULL AND nxt <> pole)"
YAWS = """e AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k), v AS (SELECT e.a, e.b, CAST(q.x - p.x AS DOUBLE) AS dx, CAST(q.y - p.y AS DOUBLE) AS dy FROM e JOIN {node} p ON p.node_id = e.a JOIN {node} q ON q.node_id = e.b),
u AS (SELECT a, b, dx / sqrt(dx * dx + dy * dy) AS ux, dy / sqrt(dx * dx + dy * dy) AS uy FROM v WHERE dx <> 0 OR dy <> 0),
g AS (SELECT a, count(*) AS k, min_by(ux, b) AS fx, min_by(uy, b) AS fy, max_by(ux, b) AS lx, max_by(uy, b) AS ly, round(sum(ux), 9) AS sx, round(sum(uy), 9) AS sy FROM u GROUP BY a),
y AS (SELECT a, k, CASE WHEN k = 2 AND fx * lx + fy * ly < -0.85e0 THEN degrees(atan2(fy, fx)) - 90 WHEN sx = 0 AND sy = 0 THEN degrees(atan2(fy, fx)) ELSE degrees(atan2(sy, sx)) END AS yaw FROM g)"""


def yaws(v):
    poles = v("node").select(F.col("node_id").alias("pole"), "x", "y")
    links = L.links(v("way_node").select("way_id", "seq", F.col("node_id").alias("pole"), F.lit(1).alias("radius")))
    return N.headings(links, poles)


@query("AGG_22_pole_heading", f"WITH {LINKS}, {YAWS} SELECT node_id AS pole, round(coalesce(yaw, 0), 4) AS yaw FROM {{node}} LEFT JOIN y ON y.a = node_id")
def _(v):
    return yaws(v).select("pole", F.round("yaw", 4).alias("yaw"))


@query("AGG_23_chain_end_turn", f"WITH {LINKS}, {YAWS} SELECT node_id AS pole, round(coalesce(yaw, 0) + CASE WHEN y.k = 1 THEN 90 ELSE 0 END, 4) AS yaw FROM {{node}} LEFT JOIN y ON y.a = node_id")
def _(v):
    return N.quarter_turn_ends(yaws(v)).select("pole", F.round("yaw", 4).alias("yaw"))


def hits(v):
    segs = C.segments(v("way_pt"))
    points = v("footprint").select(F.col("footprint_id").alias("point_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    near = G.nearest_segments(points, segs, 100, 256)
    starts = L.measured(v("way_pt")).select("way_id", F.col("seq").alias("seg"), "start")
    return near.join(segs, ["way_id", "seg"]).join(points, "point_id").join(starts, ["way_id", "seg"])


HIT = f"""{NEAR}, h AS (SELECT n.*, f.x AS px, f.y AS py, g.x1, g.y1, g.x2, g.y2, CASE WHEN g.x1 = g.x2 AND g.y1 = g.y2 THEN 0e0 ELSE greatest(0e0, least(1e0, ((f.x - x1) * (x2 - x1) + (f.y - y1) * (y2 - y1)) / CAST((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS DOUBLE))) END AS t, sqrt(CAST((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS DOUBLE)) AS len FROM n JOIN g USING (way_id, seg) JOIN {{footprint}} f ON f.footprint_id = n.point_id WHERE k = 1),
i AS (SELECT *, x1 + t * (x2 - x1) AS fx, y1 + t * (y2 - y1) AS fy, -(y2 - y1) / len AS nx, (x2 - x1) / len AS ny FROM h)"""


@query("JOIN_21_snap_to_road", f"WITH {HIT} SELECT point_id, round(fx + nx * 5 * CASE WHEN (px - fx) * nx + (py - fy) * ny >= 0 THEN 1 ELSE -1 END, 4) AS x, round(fy + ny * 5 * CASE WHEN (px - fx) * nx + (py - fy) * ny >= 0 THEN 1 ELSE -1 END, 4) AS y FROM i WHERE len > 0")
def _(v):
    return N.snapped(hits(v), 3.0, 2.0).select("point_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("JOIN_22_face_road", f"WITH {HIT} SELECT point_id, round(CASE WHEN d2 <= 2500 AND d2 > 0 THEN degrees(atan2(fy - py, fx - px)) ELSE 0 END, 3) AS yaw FROM i")
def _(v):
    return N.facing(hits(v), 50.0).select("point_id", F.round("yaw", 3).alias("yaw"))


@query("JOIN_28_linear_reference", f"WITH {HIT}, c AS (SELECT way_id, seg, sum(sqrt(CAST((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS DOUBLE))) OVER (PARTITION BY way_id ORDER BY seg) - sqrt(CAST((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS DOUBLE)) AS start FROM g WHERE x2 IS NOT NULL) SELECT point_id, round(greatest(0e0, least(1e0, 0.5e0 + ((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)) / len / 20)), 4) AS u, round((start + t * len) / 10, 4) AS v FROM i JOIN c USING (way_id, seg) WHERE len > 0")
def _(v):
    return N.referenced(hits(v), 20.0, 10.0).select("point_id", F.round("u", 4).alias("u"), F.round("v", 4).alias("v"))


@query("JOIN_19_best_match_no_turn", f"WITH {KINDS} SELECT footprint_id, arg_min(ord, (-round(least(a.width, b.width) / CAST(greatest(a.width, b.width) AS DOUBLE) + least(a.depth, b.depth) / CAST(greatest(a.depth, b.depth) AS DOUBLE), 9), ord)) AS ord FROM {{footprint}} a JOIN kinds USING (kind) JOIN {{building}} b ON b.category = kinds.category WHERE least(a.width, b.width) / CAST(greatest(a.width, b.width) AS DOUBLE) >= 0.7e0 AND least(a.depth, b.depth) / CAST(greatest(a.depth, b.depth) AS DOUBLE) >= 0.7e0 GROUP BY footprint_id")
def _(v):
    size = ["category", "width", "depth"]
    kinds = v("building").groupBy(*size).agg(F.min("ord").alias("ord"))
    both = wanted(v).select(*size).distinct().alias("a").join(kinds.alias("b"), F.col("a.category") == F.col("b.category"))
    ratio = lambda c: F.least(F.col(f"a.{c}"), F.col(f"b.{c}")) / F.greatest(F.col(f"a.{c}"), F.col(f"b.{c}"))
    rows = both.select(*[F.col(f"a.{c}").alias(c) for c in size], "b.ord", ratio("width").alias("w"), ratio("depth").alias("d")).where("w >= 0.7D AND d >= 0.7D")
    best = rows.groupBy(*size).agg(F.min_by("ord", F.struct(-F.round(F.col("w") + F.col("d"), 9), "ord")).alias("ord"))
    return wanted(v).join(best, size).select("footprint_id", "ord")


VARIANT = "(SELECT feature_id, CASE WHEN w > 30 THEN 'roads' WHEN h > 20 THEN 'foundations' ELSE 'plain' END AS variant FROM {rect})"


@query("JOIN_29_variant_fallback", f"SELECT feature_id, variant FROM {VARIANT} WHERE variant = 'roads' OR (variant = 'foundations' AND NOT EXISTS (SELECT 1 FROM {VARIANT} WHERE variant = 'roads'))")
def _(v):
    rows = v("rect").select("feature_id", F.when(F.col("w") > 30, "roads").when(F.col("h") > 20, "foundations").otherwise("plain").alias("variant"))
    return N.fallback_variant(rows, {"roads": 0, "foundations": 1, "plain": 2})


@query("JOIN_30_channel_fallback", "SELECT way_id, k AS variant FROM {way_tag} WHERE k = 'highway'")
def _(v):
    rows = v("way_tag").select("way_id", F.col("k").alias("variant")).where("variant IN ('highway', 'area')")
    return N.fallback_variant(rows, {"extended": 0, "highway": 1, "area": 2})


@query("WIN_13_round_robin_deal", "SELECT (x * 73856093 + y * 19349663) % 2147483647 % 4 AS asset, count(*) AS n FROM {mask} GROUP BY 1")
def _(v):
    return N.dealt(v("mask"), 4).groupBy("asset").agg(F.count("*").alias("n"))


LABELS = "WITH RECURSIVE m AS (SELECT y, x, y * 1048576 + x AS id FROM {mask}), e AS (SELECT a.id, b.id AS nb FROM m a JOIN m b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1), r AS (SELECT id, id AS label FROM m UNION SELECT e.nb, r.label FROM r JOIN e ON e.id = r.id WHERE r.label < e.nb), l AS (SELECT id // 1048576 AS y, id % 1048576 AS x, min(label) AS label FROM r GROUP BY id)"


@query("WIN_19_component_sample", f"{LABELS}, c AS (SELECT *, avg(y) OVER w AS cy, avg(x) OVER w AS cx, count(*) OVER w AS n, row_number() OVER (PARTITION BY label ORDER BY y, x) - 1 AS k FROM l WINDOW w AS (PARTITION BY label)), d AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round((y - cy) * (y - cy) + (x - cx) * (x - cx), 6), y, x) AS nearest FROM c) SELECT label, y, x, CASE WHEN nearest = 1 THEN 'centre' ELSE 'step' END AS kind FROM d WHERE nearest = 1 OR (n > 5 AND k % 5 = 0)")
def _(v):
    return N.sampled_components(R.components(v("mask")), 5)


@query("RAS_16_small_components", f"{LABELS}, s AS (SELECT label FROM l GROUP BY label HAVING count(*) >= 3) SELECT y, x FROM l SEMI JOIN s USING (label)")
def _(v):
    labelled = R.components(v("mask"))
    large = labelled.groupBy("label").agg(F.count("*").alias("n")).where("n >= 3")
    return labelled.join(large, "label", "left_semi").select("y", "x")


@query("AGG_30_border_mode", "WITH i AS (SELECT DISTINCT y, x FROM {soil} WHERE class = 0), d AS (SELECT DISTINCT y + a.range AS y, x + b.range AS x FROM i, range(-1, 2) a, range(-1, 2) b) SELECT class, count(*) AS n FROM {soil} SEMI JOIN d USING (y, x) ANTI JOIN i USING (y, x) GROUP BY class")
def _(v):
    own = v("soil").where("class = 0")
    rim = C.difference(C.dilated(own, 1, *extent(v)), own)
    return v("soil").join(rim, ["y", "x"], "left_semi").groupBy("class").agg(F.count("*").alias("n"))


@query("FN_09_hash_choice", "SELECT node_id AS id, CASE node_id % 2 WHEN 0 THEN CASE (node_id * 73856093 + 5) % 2147483647 % 2 WHEN 0 THEN 'fir' ELSE 'pine' END ELSE CASE (node_id * 73856093 + 5) % 2147483647 % 3 WHEN 0 THEN 'ash' WHEN 1 THEN 'elm' ELSE 'oak' END END AS asset FROM {node}")
def _(v):
    classes = v.spark.createDataFrame([(0, "fir"), (0, "pine"), (1, "oak"), (1, "ash"), (1, "elm")], "class long, asset string")
    return N.chosen(v("node").select(F.col("node_id").alias("id"), (F.col("node_id") % 2).alias("class")), classes, 5)


@query("FN_06_vectors", "SELECT node_id, round(sqrt(CAST(x * x + y * y AS DOUBLE)), 5) AS length, round(CASE WHEN x = 0 AND y = 0 THEN 0 ELSE y / sqrt(CAST(x * x + y * y AS DOUBLE)) END, 6) AS right_x FROM {node}")
def _(v):
    n = F.sqrt((F.col("x") * F.col("x") + F.col("y") * F.col("y")).cast("double"))
    return v("node").select("node_id", F.round(n, 5).alias("length"), F.round(F.when(n > 0, F.col("y") / n).otherwise(0.0), 6).alias("right_x"))


@query("FN_07_arrays", "SELECT way_id, min_by(node_id, seq) AS first, max_by(node_id, seq) AS last, count(*) + 1 AS closed FROM {way_node} GROUP BY way_id")
def _(v):
    ring = v("way_node").groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "node_id"))), lambda s: s["node_id"]).alias("r"))
    closed = F.concat("r", F.slice("r", 1, 1))
    return ring.select("way_id", F.element_at("r", 1).alias("first"), F.element_at(F.reverse("r"), 1).alias("last"), F.size(closed).cast("long").alias("closed"))


@query("TOP_03_budgeted_selection", "WITH r AS (SELECT feature_id, w > 30 AS required FROM {rect}), o AS (SELECT feature_id, row_number() OVER (ORDER BY feature_id) - 1 AS k FROM r WHERE NOT required) SELECT feature_id FROM r WHERE required UNION ALL SELECT feature_id FROM o WHERE k % 37 = 0 AND k // 37 < 100")
def _(v):
    rows = v("rect").select("feature_id", (F.col("w") > 30).alias("required"))
    optional = G.dense_ids(rows.where("NOT required"), ["feature_id"]).where("new_id % 37 = 0 AND new_id div 37 < 100")
    return rows.where("required").select("feature_id").unionByName(optional.select("feature_id"))


@query("POLY_11_fit_into_bounds", "SELECT way_id, count(*) AS parts FROM (SELECT way_id, seq, x - 1000 AS x1, y - 1000 AS y1, lead(x) OVER w - 1000 AS x2, lead(y) OVER w - 1000 AS y2 FROM {way_pt} WINDOW w AS (PARTITION BY way_id ORDER BY seq)) WHERE x2 IS NOT NULL AND least(x1, x2) >= 0 AND greatest(x1, x2) <= 2000 AND least(y1, y2) >= 0 AND greatest(y1, y2) <= 2000 GROUP BY way_id")
def _(v):
    moved = v("way_pt").select("way_id", "seq", (F.col("x") - 1000).alias("x"), (F.col("y") - 1000).alias("y"))
    segs = C.segments(moved)
    kept = N.clipped_lines(segs, 2000).join(segs, ["way_id", "seg"]).where("abs(ax - x1) < 1e-6 AND abs(ay - y1) < 1e-6 AND abs(bx - x2) < 1e-6 AND abs(by - y2) < 1e-6")
    return kept.groupBy("way_id").agg(F.count("*").alias("parts"))


@query("POLY_12_field_padding", "SELECT feature_id, CASE WHEN w >= 6 AND h >= 6 THEN (w - 5) * (h - 5) ELSE (w + 1) * (h + 1) END AS cells FROM {rect}")
def _(v):
    return C.eroded_sizes(v("rect"), 3, 8192, 8192).select("feature_id", F.when(F.col("cells") > 0, F.col("cells")).otherwise(F.col("whole")).alias("cells"))


@query("POLY_16_line_components")
def POLY_16(v):
    """Ways that share a node are connected; the shared nodes are the hubs, so no pairs of ways are made."""
    own = v("way_node").select("way_id", "node_id").distinct().checkpoint()
    labels = own.select("way_id").distinct().withColumn("component", F.col("way_id"))
    while True:
        hubs = own.join(labels, "way_id").groupBy("node_id").agg(F.min("component").alias("low"))
        low = own.join(hubs, "node_id").groupBy("way_id").agg(F.min("low").alias("low"))
        step = labels.join(low, "way_id").select("way_id", "component", F.least("component", "low").alias("next"))
        further = step.select(F.col("way_id").alias("next"), F.col("next").alias("jump"))
        after = step.join(further, "next").select("way_id", F.col("component").alias("before"), F.least("next", "jump").alias("component")).checkpoint()
        labels = after.select("way_id", "component")
        if after.where("component <> before").isEmpty():
            return labels


@query("RAS_02_quarter_rotation", "SELECT x AS y, 499 - y AS x, v FROM {dem}")
def _(v):
    return v("dem").select(F.col("x").alias("y"), (extent(v)[1] - 1 - F.col("y")).alias("x"), "v")


@query("RAS_09_normalised_convolution", "WITH m AS (SELECT * FROM {dem} WHERE v > 68000) SELECT c.y, c.x, round(avg(o.v), 4) AS v FROM m c JOIN m o ON o.y BETWEEN c.y - 1 AND c.y + 1 AND o.x BETWEEN c.x - 1 AND c.x + 1 GROUP BY c.y, c.x")
def _(v):
    own = v("dem").where("v > 68000")
    near = R.neighbourhood(own, "v", 1, *extent(v)).groupBy("y", "x").agg((F.sum("n") / F.count("*")).alias("v"))
    return near.join(own.select("y", "x"), ["y", "x"], "left_semi").select("y", "x", F.round("v", 4).alias("v"))


@query("RAS_14_subtract_by_mask", "SELECT y, x, CASE WHEN v > 68000 THEN v - 100 ELSE v END AS v FROM {dem}")
def _(v):
    return R.masked_replace(v("dem"), v("dem").withColumn("v", F.col("v") - 100), v("mask"))


@query("RAS_22_ground_cover", "SELECT y, x, CASE class WHEN 1 THEN 33 ELSE 131 END AS code FROM {soil} WHERE class IN (1, 2) AND x BETWEEN 1 AND 62 AND y BETWEEN 1 AND 498")
def _(v):
    legend = v.spark.createDataFrame([(1, 33), (2, 131)], "class long, code int")
    width, height = extent(v)
    return v("soil").where(F.col("x").between(1, width - 2) & F.col("y").between(1, height - 2)).join(F.broadcast(legend), "class").select("y", "x", "code")


@query("MESH_04_quadrants", "WITH f AS (SELECT (y // 8) * 7 + x // 8 AS q, x + CASE t.range WHEN 0 THEN 8 / 3e0 ELSE 16 / 3e0 END AS cx, y + CASE t.range WHEN 0 THEN 16 / 3e0 ELSE 8 / 3e0 END AS cy FROM {dem}, range(2) t WHERE x % 8 = 0 AND y % 8 = 0 AND x // 8 < 7 AND y // 8 < 62) SELECT cx - 28 <= 0 AS west, cy - 248 <= 0 AS north, count(*) AS faces FROM f GROUP BY 1, 2")
def _(v):
    width, height = extent(v)
    vertices, faces = R.mesh(v("dem"), width, height, 8)
    mid_x, mid_y = ((-(-n // 8) - 1) * 4 for n in (width, height))
    corner = faces.select("fid", F.explode(F.array("v1", "v2", "v3")).alias("vid")).join(vertices, "vid")
    centre = corner.groupBy("fid").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    return centre.groupBy((F.col("cx") - mid_x <= 0).alias("west"), (F.col("cy") - mid_y <= 0).alias("north")).agg(F.count("*").alias("faces"))


@query("MESH_06_line_strip", "SELECT way_id, 2 * count(*) AS vertices, 2 * (count(*) - 1) AS faces FROM {way_pt} GROUP BY way_id HAVING count(*) >= 2")
def _(v):
    sides = L.perpendiculars(v("way_pt")).withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1))))
    counted = sides.groupBy("way_id").agg(F.count("*").alias("vertices")).where("vertices >= 4")
    return counted.select("way_id", "vertices", (F.col("vertices") - 2).alias("faces"))


@query("SRC_16_catalogue_checks", "SELECT ord, width, depth FROM {building} WHERE category LIKE 'S%' AND width > 0 AND depth > 5")
def _(v):
    typed = v("building").where("category LIKE 'S%'").select("ord", F.col("width").cast("string").try_cast("long").alias("width"), F.col("depth").cast("string").try_cast("long").alias("depth"))
    return typed.where("width > 0 AND depth > 5")


@query("SRC_21_info_layers", "SELECT k AS layer_key, count(*) AS n FROM {way_tag} WHERE k IN ('highway', 'landuse') GROUP BY k")
def _(v):
    path = f"{v.spark.sparkContext.getCheckpointDir()}/info-{uuid.uuid4().hex}"
    v("way_tag").select("way_id", "v", F.col("k").alias("layer_key")).write.partitionBy("layer_key").parquet(path)
    published = v.spark.read.parquet(path)
    return published.where("layer_key IN ('highway', 'landuse')").groupBy("layer_key").agg(F.count("*").alias("n"))


@query("SRC_22_named_info_layer", "SELECT way_id, v FROM {way_tag} WHERE k = 'highway'")
def _(v):
    path = f"{v.spark.sparkContext.getCheckpointDir()}/info-{uuid.uuid4().hex}"
    v("way_tag").select("way_id", "v", F.col("k").alias("layer_key")).write.partitionBy("layer_key").parquet(path)
    return v.spark.read.parquet(path).where("layer_key = 'highway'").select("way_id", "v")


@query("FLT_10_layer_selection", "SELECT v AS layer, CASE WHEN v = 'forest' THEN 'base' ELSE 'drawn' END AS kind FROM {way_tag} WHERE k = 'landuse' GROUP BY v")
def _(v):
    return v("way_tag").where("k = 'landuse'").select(F.col("v").alias("layer")).distinct().withColumn("kind", F.when(F.col("layer") == "forest", "base").otherwise("drawn"))


@query("FLT_23_wire_capable", "SELECT node_id FROM {node_tag} WHERE lower(v) <> 'tree'")
def _(v):
    return v("node_tag").where(F.lower("v") != "tree").select("node_id")


@query("JOB_06_soil_share", "WITH c AS (SELECT c.y, c.x, o.class, count(*) AS n FROM {soil} c JOIN {soil} o ON o.y BETWEEN c.y - 1 AND c.y + 1 AND o.x BETWEEN c.x - 1 AND c.x + 1 GROUP BY ALL), s AS (SELECT y, x, arg_max(class, (n, -class)) AS class FROM c GROUP BY y, x) SELECT class, count(*) AS n, round(count(*) / 32000e0, 6) AS share FROM s GROUP BY class")
def _(v):
    return R.shares(R.majority(v("soil"), 1, *extent(v)))
