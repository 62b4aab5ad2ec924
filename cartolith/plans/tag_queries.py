"""Queries over tag rules, boxes, frames and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolith.functions import scalars as S
from cartolith.operators import frames as R
from cartolith.operators import tags as T
from cartolith.plans.fixtures import Register

query = Register()
QUERIES, SQL = query.queries, query.sql

ROADS = {"highway": ["motorway", "trunk", "primary"]}
FARM = {"landuse": ["farmland", "meadow"]}
WOOD = {"landuse": "forest"}
HAS = "EXISTS (SELECT 1 FROM {{way_tag}} q WHERE q.way_id = t.way_id AND {})"
MAPS = "WITH t AS (SELECT DISTINCT way_id FROM {way_tag})"


def way_maps(v):
    return T.tag_map(v("way_tag"), "way_id")


def has(condition: str) -> str:
    return HAS.format(condition).replace("{{", "{").replace("}}", "}")


@query("SRC_04_tag_extraction", "SELECT way_id, count(DISTINCT k) AS n_tags, string_agg(k || '=' || v, ';' ORDER BY k) AS tags FROM {way_tag} GROUP BY way_id")
def _(v):
    entries = F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return way_maps(v).select("way_id", F.size("tags").cast("long").alias("n_tags"), F.array_join(entries, ";").alias("tags"))


@query("FLT_01_tag_predicate", f"{MAPS} SELECT way_id, {has(chr(39) + 'x' + chr(39) + ' = ' + chr(39) + 'x' + chr(39) + ' AND k = ' + chr(39) + 'highway' + chr(39))} AND {has('k = ' + chr(39) + 'area' + chr(39) + ' AND v = ' + chr(39) + 'no' + chr(39))} AS hit FROM t")
def _(v):
    return way_maps(v).select("way_id", T.matches(F.col("tags"), {"highway": True, "area": False}).alias("hit"))


@query(
    "FLT_02_first_matching_rule",
    f"{MAPS} SELECT way_id, CASE WHEN {has("k = 'highway' AND v IN ('motorway', 'trunk', 'primary')")} THEN 0 WHEN {has("k = 'landuse' AND v = 'forest'")} THEN 1 WHEN {has("k = 'landuse' AND v IN ('farmland', 'meadow')")} THEN 2 END AS rule_no FROM t",
)
def _(v):
    return way_maps(v).select("way_id", T.first_match(F.col("tags"), [ROADS, {}, WOOD, FARM]).alias("rule_no"))


@query("FLT_03_any_key_filter", f"{MAPS} SELECT way_id FROM t WHERE {has("k = 'landuse' AND v = 'forest'")} OR {has("k = 'highway' AND v = 'track'")}")
def _(v):
    return way_maps(v).where(T.matches_any(F.col("tags"), {"landuse": "forest", "highway": "track"})).select("way_id")


@query("FLT_04_canonical_tag", "SELECT v AS value, count(*) AS n FROM {way_tag} WHERE (k = 'highway' AND v = 'motorway') OR (k = 'landuse' AND v = 'farmland') GROUP BY v")
def _(v):
    pairs = [T.canonical_tag(r) for r in (ROADS, FARM, {"highway": True}) if T.canonical_tag(r)]
    rules = F.broadcast(v.spark.createDataFrame(pairs, "k string, v string"))
    return v("way_tag").join(rules, ["k", "v"]).groupBy(F.col("v").alias("value")).agg(F.count("*").alias("n"))


@query("FLT_05_precise_tags", f"{MAPS} SELECT way_id, CASE WHEN {has("k = 'area'")} THEN 'precise' ELSE 'plain' END AS used FROM t")
def _(v):
    tags = F.col("tags")
    precise = F.map_filter(tags, lambda k, x: k == "area")
    return way_maps(v).select("way_id", F.when(F.map_contains_key(T.resolved_tags(F.create_map(F.lit("plain"), F.lit("1")), precise, True), "area"), "precise").otherwise("plain").alias("used"))


@query("FLT_19_scrub_tags", "SELECT way_id, string_agg(k, ';' ORDER BY k) FILTER (k <> 'id') AS keys FROM {way_tag} GROUP BY way_id")
def _(v):
    return way_maps(v).select("way_id", F.array_join(F.map_keys(T.scrub(F.col("tags"))), ";").alias("keys"))


@query("FLT_20_output_tags", "SELECT way_id, string_agg(k, ';' ORDER BY k) FILTER (k <> 'type') AS keys FROM {way_tag} GROUP BY way_id")
def _(v):
    return way_maps(v).select("way_id", F.array_join(F.map_keys(T.output_tags(F.col("tags"))), ";").alias("keys"))


@query("FN_03_canonical_json", "SELECT '{\"' || string_agg(k || '\":\"' || v, '\",\"' ORDER BY k) || '\"}' AS tags, way_id FROM {way_tag} GROUP BY way_id")
def _(v):
    return way_maps(v).select("way_id", T.canonical_json(F.col("tags")).alias("tags"))


@query("FN_08_map_operations", "SELECT way_id, count(*) FILTER (k <> 'area') + 1 AS n, bool_or(k = 'area') AS has_area FROM {way_tag} GROUP BY way_id")
def _(v):
    merged = F.map_concat(F.map_filter("tags", lambda k, x: k != "area"), F.create_map(F.lit("layer"), F.lit("base")))
    return way_maps(v).select("way_id", F.size(merged).cast("long").alias("n"), F.map_contains_key("tags", "area").alias("has_area"))


ENDS = "SELECT way_id, count(*) AS n, min_by(node_id, seq) AS a, max_by(node_id, seq) AS b FROM {way_node} GROUP BY way_id"


@query(
    "FLT_08_area_heuristic",
    f"WITH e AS ({ENDS}) SELECT t.way_id, n >= 4 AND a = b AND CASE WHEN {has("k = 'area' AND v = 'no'")} THEN false WHEN {has("k = 'area' AND v = 'yes'")} THEN true ELSE NOT {has("k = 'highway'")} END AS is_area FROM e t",
)
def _(v):
    ends = v("way_node").groupBy("way_id").agg(F.count("*").alias("n"), F.min_by("node_id", "seq").alias("a"), F.max_by("node_id", "seq").alias("b"))
    return ends.join(way_maps(v), "way_id").select("way_id", T.is_area(F.col("a"), F.col("b"), F.col("n"), F.col("tags")).alias("is_area"))


@query("FLT_09_splitter", f"{MAPS} SELECT way_id, {has("k = 'highway'")} AND NOT {has("k = 'highway' AND v = 'path'")} AS cuts FROM t")
def _(v):
    return way_maps(v).select("way_id", T.is_splitter(F.col("tags"), {"highway": "path"}).alias("cuts"))


@query("SRC_05_feature_source", "SELECT feature_id FROM {rect} WHERE status = 'F' AND x0 <= 2000 AND x0 + w >= 1000 AND y0 <= 2500 AND y0 + h >= 500")
def _(v):
    box = (F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h"))
    return v("rect").where((F.col("status") == "F") & R.boxes_overlap(box, (1000, 500, 2000, 2500))).select("feature_id")


@query("FLT_06_box_overlap", "SELECT feature_id, x0 <= 3000 AND x0 + w >= 100 AND y0 <= 3000 AND y0 + h >= 200 AS hit FROM {rect}")
def _(v):
    box = (F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h"))
    return v("rect").select("feature_id", R.boxes_overlap(box, (100, 200, 3000, 3000)).alias("hit"))


@query(
    "FLT_07_spatial_rules",
    "SELECT feature_id FROM {rect} WHERE (status = 'F' AND x0 <= 900 AND x0 + w >= 300 AND y0 <= 4000 AND y0 + h >= 0) OR (status = 'O' AND x0 <= 4000 AND x0 + w >= 0 AND y0 <= 700 AND y0 + h >= 200)",
)
def _(v):
    rules = v.spark.createDataFrame([("landuse", "farmland", 300, 0, 900, 4000), ("landuse", "forest", 0, 200, 4000, 700)], "k string, v string, x0 long, y0 long, x1 long, y1 long")
    boxes = v("rect").select("feature_id", F.col("x0").alias("minx"), F.col("y0").alias("miny"), (F.col("x0") + F.col("w")).alias("maxx"), (F.col("y0") + F.col("h")).alias("maxy"))
    tagged = boxes.join(v("way_tag").where("k = 'landuse'").withColumnRenamed("way_id", "feature_id"), "feature_id")
    return R.spatial_rule_hits(tagged, rules).select("feature_id")


@query("FLT_12_lonlat_to_pixel", "SELECT node_id, CAST(trunc((lon - 19.79e0) / (19.85e0 - 19.79e0) * 4096) AS BIGINT) AS px, CAST(trunc((45.41e0 - lat) / (45.41e0 - 45.35e0) * 4096) AS BIGINT) AS py FROM {node}")
def _(v):
    px, py = R.pixel(F.col("lon"), F.col("lat"), (19.79, 45.35, 19.85, 45.41), 4096)
    return v("node").select("node_id", px.alias("px"), py.alias("py"))


@query(
    "FLT_13_box_around_centre",
    "SELECT node_id, round(lon - degrees(2048.0 / 6371009.0) / cos(radians(lat)), 6) AS west, round(lat - degrees(2048.0 / 6371009.0), 6) AS south, round(lon + degrees(2048.0 / 6371009.0) / cos(radians(lat)), 6) AS east, round(lat + degrees(2048.0 / 6371009.0), 6) AS north FROM {node}",
)
def _(v):
    names = ("west", "south", "east", "north")
    return v("node").select("node_id", *[F.round(c, 6).alias(n) for n, c in zip(names, R.box_around(F.col("lon"), F.col("lat"), 2048.0), strict=True)])


@query("FLT_14_utm_zone", "SELECT node_id, CAST(greatest(1, least(60, floor((lon + 180) / 6) + 1)) AS BIGINT) + CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END AS epsg FROM {node}")
def _(v):
    return v("node").select("node_id", R.utm_zone(F.col("lon"), F.col("lat")).alias("epsg"))


@query(
    "FLT_15_rotated_rectangle",
    "WITH c AS (SELECT * FROM (VALUES (0, -10, -5), (1, 10, -5), (2, 10, 5), (3, -10, 5), (4, -10, -5)) c(corner, cx, cy)) SELECT node_id, CAST(corner AS BIGINT) AS corner, round(x + cx * cos(radians(30)) - cy * sin(radians(30)), 4) AS px, round(y + cx * sin(radians(30)) + cy * cos(radians(30)), 4) AS py FROM {node}, c",
)
def _(v):
    corners = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(x).alias("x"), F.lit(y).alias("y")) for k, x, y in R.rotated_corner(20, 10, 30)])
    rows = v("node").select("node_id", "x", "y", F.explode(corners).alias("c"))
    return rows.select("node_id", F.col("c.k").alias("corner"), F.round(F.col("x") + F.col("c.x"), 4).alias("px"), F.round(F.col("y") + F.col("c.y"), 4).alias("py"))


@query("FLT_16_scale_points", "SELECT way_id, seq, CAST(trunc(x * 0.37e0) AS BIGINT) AS x, CAST(trunc(y * 0.37e0) AS BIGINT) AS y FROM {way_pt}")
def _(v):
    return v("way_pt").select("way_id", "seq", R.scaled(F.col("x"), 0.37).alias("x"), R.scaled(F.col("y"), 0.37).alias("y"))


@query("FLT_17_shift_frame", "SELECT way_id, seq, x + 384 AS x, y + 384 AS y FROM {way_pt}")
def _(v):
    d = R.frame_delta(4096, 5120, 0.75)
    return v("way_pt").select("way_id", "seq", (F.col("x") + d).alias("x"), (F.col("y") + d).alias("y"))


@query("FLT_18_centre_frame", "SELECT node_id, x - 2048 AS x, y - 2048 AS y FROM {node}")
def _(v):
    return v("node").select("node_id", R.centred(F.col("x"), 4096).alias("x"), R.centred(F.col("y"), 4096).alias("y"))


@query("FLT_22_ring_filter", "SELECT node_id FROM {node} WHERE NOT (abs(x - 2048) <= 1200 AND abs(y - 2048) <= 1200)")
def _(v):
    return v("node").where(R.outside_square(F.col("x"), F.col("y"), 2048, 1200)).select("node_id")


@query("FLT_25_clamp_bounds", "SELECT node_id, greatest(1000, least(3000, CAST(round_even(x / 2.0e0, 0) AS BIGINT))) AS x FROM {node}")
def _(v):
    return v("node").select("node_id", R.clamped(F.col("x") / 2, 1000, 3000).alias("x"))


@query("FLT_27_step_tables", "SELECT node_id, CASE WHEN x <= 2048 THEN 2048 ELSE 4096 END AS resolution FROM {node}")
def _(v):
    return v("node").select("node_id", R.texture_resolution(F.col("x")).alias("resolution"))


@query("FLT_28_polygon_guard", "SELECT way_id, count(*) AS n FROM {way_pt} GROUP BY way_id HAVING count(*) >= 3")
def _(v):
    return v("way_pt").groupBy("way_id").agg(F.count("*").alias("n")).where("n >= 3")


@query("FLT_24_valid_lines", "SELECT way_id, count(*) AS n FROM {way_pt} GROUP BY way_id HAVING count(*) >= 2 AND min(x) >= 0 AND max(x) < 4096 AND min(y) >= 0 AND max(y) < 4096")
def _(v):
    inside = [F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d")]
    return v("way_pt").groupBy("way_id").agg(F.count("*").alias("n"), *inside).where("n >= 2 AND a >= 0 AND b < 4096 AND c >= 0 AND d < 4096").select("way_id", "n")


@query("AGG_04_obstacle_radius", "SELECT node_id, max(CASE v WHEN 'pole' THEN 4 WHEN 'tower' THEN 9 WHEN 'tree' THEN 2 END) AS radius FROM {node_tag} GROUP BY node_id")
def _(v):
    return T.lookup_radius(v("node_tag"), "node_id", {("power", "pole"): 4, ("power", "tower"): 9, ("natural", "tree"): 2}).withColumn("radius", F.col("radius").cast("int"))


@query("JOIN_07_point_obstacles", "SELECT node_id, x, y, max(CASE v WHEN 'pole' THEN 4 ELSE 9 END) AS radius FROM {node_tag} JOIN {node} USING (node_id) WHERE k = 'power' GROUP BY ALL")
def _(v):
    radius = T.lookup_radius(v("node_tag"), "node_id", {("power", "pole"): 4, ("power", "tower"): 9})
    return v("node").join(radius, "node_id").select("node_id", "x", "y", F.col("radius").cast("int").alias("radius"))


@query("AGG_05_merge_key", "SELECT k || '=' || CASE WHEN k = 'landuse' THEN 'farmland' ELSE v END AS merge_key, count(*) AS n FROM {way_tag} WHERE k = 'landuse' GROUP BY 1")
def _(v):
    return way_maps(v).where(F.map_contains_key("tags", "landuse")).groupBy(T.merge_key(F.col("tags"), FARM, True).alias("merge_key")).agg(F.count("*").alias("n"))


@query(
    "AGG_06_common_tags",
    "WITH m AS (SELECT o_custkey AS cust, o_orderkey AS way_id FROM {orders}), s AS (SELECT cust, count(DISTINCT way_id) AS size FROM m GROUP BY cust) SELECT cust, k, min(v) AS v FROM m JOIN {way_tag} USING (way_id) JOIN s USING (cust) WHERE k NOT IN ('id') GROUP BY cust, k, size HAVING count(DISTINCT way_id) = size AND min(v) = max(v)",
)
def _(v):
    members = v("orders").select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("way_id"))
    return T.common_tags(v("way_tag"), members, "cust", "way_id", ("id",))


@query("JOIN_15_category_by_tag", "SELECT way_id, CASE min(CASE WHEN k = 'landuse' AND v = 'forest' THEN 0 WHEN k = 'highway' AND v = 'track' THEN 1 WHEN k = 'area' AND v = 'yes' THEN 2 END) WHEN 0 THEN 'wood' WHEN 1 THEN 'lane' WHEN 2 THEN 'plot' END AS category FROM {way_tag} WHERE (k = 'landuse' AND v = 'forest') OR (k = 'highway' AND v = 'track') OR (k = 'area' AND v = 'yes') GROUP BY way_id")
def _(v):
    return T.category_of(v("way_tag"), "way_id", [("landuse", "forest", "wood"), ("highway", "track", "lane"), ("area", "yes", "plot")])


@query("JOIN_16_electricity_category", "SELECT node_id, coalesce(max(CASE WHEN k = 'power' AND v = 'tower' THEN 'high' WHEN k = 'power' THEN 'low' END), 'default') AS category FROM {node_tag} GROUP BY node_id")
def _(v):
    found = T.category_of(v("node_tag"), "node_id", [("power", "tower", "high"), ("power", "pole", "low")])
    return v("node_tag").select("node_id").distinct().join(found, "node_id", "left").select("node_id", F.coalesce("category", F.lit("default")).alias("category"))


@query("FN_01_names", r"SELECT asset_id, lower(regexp_replace(regexp_replace(name, '[^A-Za-z0-9_\-]+', '_', 'g'), '^_+|_+$', '', 'g')) AS safe, rpad(upper(substr(name, 1, 3)), 3, ' ') AS prefix FROM {asset}")
def _(v):
    return v("asset").select("asset_id", S.safe_name(F.col("name")).alias("safe"), S.plate_prefix(F.col("name")).alias("prefix"))


@query("FN_02_keyword_category", "SELECT asset_id, CASE WHEN regexp_matches(lower(name), 'house|home|almond|antique') THEN 'residential' WHEN regexp_matches(lower(name), 'farm|barn|blush|green') THEN 'farmyard' WHEN regexp_matches(lower(name), 'factory|steel|metallic') THEN 'industrial' ELSE 'commercial' END AS category FROM {asset}")
def _(v):
    return v("asset").select("asset_id", S.keyword_category(F.col("name")).alias("category"))


@query("FN_04_safe_casts", "SELECT asset_id, CASE WHEN TRY_CAST(name AS DOUBLE) > 0 THEN TRY_CAST(name AS DOUBLE) ELSE 0.01e0 END AS radius FROM (SELECT asset_id, CASE WHEN asset_id % 3 = 0 THEN name ELSE CAST(asset_id AS VARCHAR) END AS name FROM {asset})")
def _(v):
    text = F.when(F.col("asset_id") % 3 == 0, F.col("name")).otherwise(F.col("asset_id").cast("string"))
    return v("asset").select("asset_id", S.radius_or(text).alias("radius"))


@query("FN_05_angles", "SELECT asset_id, CAST(((asset_id * 37 - 400 + 90) % 180 + 180) % 180 - 90 AS BIGINT) AS folded FROM {asset}")
def _(v):
    return v("asset").select("asset_id", S.folded(F.col("asset_id") * 37 - 400).cast("long").alias("folded"))


@query("WIN_23_strength", "SELECT asset_id, round(greatest(0, least(1, (asset_id % 40 - 8) / 22.0e0)), 6) AS strength FROM {asset}")
def _(v):
    return v("asset").select("asset_id", F.round(S.strength(F.col("asset_id") % 40), 6).alias("strength"))


@query("JOIN_31_dimension_lookup", "SELECT c_custkey AS id, CASE WHEN n_name IN ('FRANCE', 'GERMANY', 'ROMANIA') THEN substr(n_name, 1, 2) END AS code, CASE WHEN n_name = 'UNITED STATES' THEN 'US' ELSE 'EU' END AS region FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey")
def _(v):
    codes = v.spark.createDataFrame([("FRANCE", "FR"), ("GERMANY", "GE"), ("ROMANIA", "RO")], "n_name string, code string")
    named = v("customer").join(v("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(codes), "n_name", "left")
    return named.select(F.col("c_custkey").alias("id"), "code", F.when(F.col("n_name") == "UNITED STATES", "US").otherwise("EU").alias("region"))


@query("SET_07_distinct_tag_queries", "SELECT DISTINCT k, v FROM {way_tag}")
def _(v):
    return v("way_tag").select("k", "v").distinct()


@query("TOP_01_layer_order", "SELECT k, row_number() OVER (ORDER BY p DESC NULLS FIRST, k) AS rank FROM (SELECT v AS k, CASE WHEN v = 'forest' THEN NULL ELSE length(v) END AS p FROM {way_tag} GROUP BY v)")
def _(v):
    from pyspark.sql.window import Window

    layers = v("way_tag").groupBy(F.col("v").alias("k")).agg(F.first("v").alias("x"))  # one row per layer: a small table
    priority = F.when(F.col("k") == "forest", F.lit(None)).otherwise(F.length("k"))
    order = Window.orderBy(priority.desc_nulls_first(), "k")
    return layers.select("k", F.row_number().over(order).cast("long").alias("rank"))
