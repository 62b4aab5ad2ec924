"""Queries over nodes, ways, relations, catalogues and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolith.operators import cells as C
from cartolith.operators import features as G
from cartolith.operators import lines as L
from cartolith.plans.fixtures import Register

query = Register()
QUERIES, SQL = query.queries, query.sql

RING = "ring AS (SELECT feature_id, seq, CASE WHEN seq IN (1, 2) THEN x0 + w ELSE x0 END AS x, CASE WHEN seq IN (2, 3) THEN y0 + h ELSE y0 END AS y FROM {rect}, (SELECT range AS seq FROM range(5)))"
SEG = """s0 AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM {way_pt} WINDOW w AS (PARTITION BY way_id ORDER BY seq)),
s AS (SELECT *, sqrt(CAST((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y) AS DOUBLE)) AS length FROM s0 WHERE x2 IS NOT NULL),
tot AS (SELECT way_id, sum(length) AS total FROM s GROUP BY way_id HAVING sum(length) > 0)"""


def rings(v):
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h")
    corners = F.array(*[F.struct(F.lit(k).cast("long").alias("seq"), x.alias("x"), y.alias("y")) for k, (x, y) in enumerate([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)])])
    return v("rect").select("feature_id", F.explode(corners).alias("p")).select("feature_id", "p.*")


@query("JOIN_01_way_geometry", "WITH g AS (SELECT way_id, seq, x, y FROM {way_node} JOIN {node} USING (node_id)) SELECT way_id, count(*) AS n, CASE WHEN count(*) >= 4 THEN 'polygon' ELSE 'line' END AS kind FROM g GROUP BY way_id HAVING count(*) >= 4 OR count(DISTINCT (x, y)) >= 2")
def _(v):
    return G.way_kinds(G.way_geometry(v("way_node"), v("node")))


@query("JOIN_03_relation_closure", "WITH RECURSIVE c AS (SELECT DISTINCT rel_id AS root, rel_id FROM {relation_member} WHERE rel_id >= 2000000 UNION SELECT root, m.ref FROM c JOIN {relation_member} m ON m.rel_id = c.rel_id AND m.type = 'relation'), w AS (SELECT DISTINCT root, ref FROM c JOIN {relation_member} m ON m.rel_id = c.rel_id AND m.type = 'way') SELECT root, count(*) AS ways FROM w GROUP BY root")
def _(v):
    members = v("relation_member")
    closed = G.closure(members, members.where("rel_id >= 2000000").select("rel_id").distinct())
    return G.reached_ways(members, closed).groupBy("root").agg(F.count("*").alias("ways"))


@query("JOIN_04_relation_bounds", "WITH RECURSIVE c AS (SELECT DISTINCT rel_id AS root, rel_id FROM {relation_member} WHERE rel_id >= 1000000 AND rel_id < 2000000 UNION SELECT root, m.ref FROM c JOIN {relation_member} m ON m.rel_id = c.rel_id AND m.type = 'relation'), w AS (SELECT DISTINCT root, ref AS way_id FROM c JOIN {relation_member} m ON m.rel_id = c.rel_id AND m.type = 'way') SELECT root, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM w JOIN {way_pt} USING (way_id) GROUP BY root")
def _(v):
    members = v("relation_member")
    closed = G.closure(members, members.where("rel_id >= 1000000 AND rel_id < 2000000").select("rel_id").distinct())
    return G.bounds(G.reached_ways(members, closed).join(v("way_pt"), "way_id"), "root")


@query("JOIN_05_target_collection", "WITH u AS (SELECT ref AS way_id, count(*) AS n FROM {relation_member} WHERE type = 'way' GROUP BY ref) SELECT t.way_id FROM {way_tag} t JOIN u USING (way_id) WHERE k = 'landuse' AND v = 'farmland' AND n = 1")
def _(v):
    once = G.usage(v("relation_member")).where("n = 1")
    return v("way_tag").where("k = 'landuse' AND v = 'farmland'").join(once, "way_id", "left_semi").select("way_id")


@query("JOIN_06_hole_collection", "SELECT DISTINCT way_id FROM {way_tag} WHERE k = 'landuse' AND v <> 'farmland' AND way_id NOT IN (SELECT ref FROM {relation_member} WHERE type = 'way' AND role = 'inner')")
def _(v):
    inner = v("relation_member").where("type = 'way' AND role = 'inner'").select(F.col("ref").alias("way_id"))
    return v("way_tag").where("k = 'landuse' AND v <> 'farmland'").join(inner, "way_id", "left_anti").select("way_id").distinct()


@query("JOIN_10_orphan_nodes", "SELECT node_id FROM {node} WHERE node_id NOT IN (SELECT node_id FROM {node_tag}) AND node_id NOT IN (SELECT node_id FROM {way_node} JOIN {way_tag} USING (way_id) WHERE v = 'motorway')")
def _(v):
    return G.orphans(v("node").select("node_id"), v("node_tag"), v("way_node").join(v("way_tag").where("v = 'motorway'"), "way_id", "left_semi"), v("relation_member"))


@query("JOIN_11_remove_replaced", "SELECT type, count(*) AS kept FROM {relation_member} WHERE ref % 9 <> 0 GROUP BY type")
def _(v):
    members = v("relation_member")
    replaced = members.where("ref % 9 = 0").select("ref").distinct()
    return members.join(replaced, "ref", "left_anti").groupBy("type").agg(F.count("*").alias("kept"))


@query("AGG_01_way_usage", "SELECT ref AS way_id, count(*) AS n FROM {relation_member} WHERE type = 'way' GROUP BY ref")
def _(v):
    return G.usage(v("relation_member"))


@query("AGG_02_way_bounds", "SELECT way_id, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM {way_node} JOIN {node} USING (node_id) GROUP BY way_id")
def _(v):
    return G.bounds(G.way_geometry(v("way_node"), v("node")), "way_id")


@query("AGG_03_end_degree", "WITH e AS (SELECT way_id, min_by(node_id, seq) AS a, max_by(node_id, seq) AS b FROM {way_node} SEMI JOIN (SELECT way_id FROM {way_tag} WHERE k = 'highway') USING (way_id) GROUP BY way_id), d AS (SELECT node_id, count(*) AS n FROM (SELECT a AS node_id FROM e UNION ALL SELECT b FROM e) GROUP BY node_id) SELECT way_id, d1.n = 1 AS round_start, d2.n = 1 AS round_end FROM e JOIN d d1 ON a = d1.node_id JOIN d d2 ON b = d2.node_id")
def _(v):
    return G.end_degrees(v("way_node").join(v("way_tag").where("k = 'highway'"), "way_id", "left_semi"))


@query("AGG_25_primitive_counts", "SELECT 'node' AS type, count(*) AS n FROM {node} UNION ALL SELECT 'way', count(DISTINCT way_id) FROM {way_node} UNION ALL SELECT 'relation', count(DISTINCT rel_id) FROM {relation_member}")
def _(v):
    one = lambda df, c, t: df.select(c).distinct().agg(F.count("*").alias("n")).select(F.lit(t).alias("type"), "n")
    return one(v("node"), "node_id", "node").unionByName(one(v("way_node"), "way_id", "way")).unionByName(one(v("relation_member"), "rel_id", "relation"))


@query("AGG_36_vertex_dedup", "SELECT count(DISTINCT (round_even(lon * 1000, 0), round_even(lat * 1000, 0))) AS n FROM {node}")
def _(v):
    keyed = v("node").select(F.bround(F.col("lon") * 1000).alias("a"), F.bround(F.col("lat") * 1000).alias("b"))
    return keyed.dropDuplicates().agg(F.count("*").alias("n"))


@query("SRC_06_merged_extracts", "SELECT type, id, min_by(payload, tile_no) AS payload, min(tile_no) AS tile_no FROM {tile_extract} GROUP BY type, id")
def _(v):
    return G.merged_extracts(v("tile_extract"))


@query("SRC_07_adaptive_subdivision", "WITH a AS (SELECT x // 2048 AS bx, y // 4096 AS \"by\", x, y FROM {node}) SELECT CAST(sum(n) AS BIGINT) AS points FROM (SELECT count(*) AS n FROM a GROUP BY bx, \"by\")")
def _(v):
    return G.subdivided(v("node"), 4096, 300).agg(F.sum("n").alias("points"))


@query("SRC_20_primitive_versions", "SELECT node_id, CASE WHEN node_id % 4 = 0 THEN node_id ELSE 1 END AS version FROM {node}")
def _(v):
    versions = v("node").withColumn("version", F.when(F.col("node_id") % 4 == 0, F.col("node_id")))
    return versions.select("node_id", F.coalesce("version", F.lit(1)).alias("version"))


@query("SRC_23_run_report", "SELECT component, max_by(seconds, ts) AS latest FROM {metric} GROUP BY component")
def _(v):
    return v("metric").groupBy("component").agg(F.max_by("seconds", "ts").alias("latest"))


@query("FLT_21_repair_filter", "SELECT type, count(*) AS kept FROM {relation_member} WHERE type <> 'relation' AND ref % 6 <> 0 GROUP BY type")
def _(v):
    marked = v("relation_member").withColumn("action", F.when(F.col("ref") % 6 == 0, "delete"))
    return marked.where("type <> 'relation' AND (action IS NULL OR action <> 'delete')").groupBy("type").agg(F.count("*").alias("kept"))


@query("SET_01_record_union", "SELECT 0 AS ord, way_id AS id FROM {way_tag} WHERE k = 'highway' UNION ALL SELECT 1, feature_id FROM {rect} WHERE status = 'F'")
def _(v):
    a = v("way_tag").where("k = 'highway'").select(F.lit(0).alias("ord"), F.col("way_id").alias("id"))
    return a.unionByName(v("rect").where("status = 'F'").select(F.lit(1).alias("ord"), F.col("feature_id").alias("id")), allowMissingColumns=True)


@query("SET_04_id_sets", "SELECT way_id FROM (SELECT way_id FROM {way_tag} WHERE v = 'forest' UNION SELECT ref FROM {relation_member} WHERE type = 'way' AND role = 'inner') EXCEPT SELECT way_id FROM {way_tag} WHERE v = 'multipolygon'")
def _(v):
    a = v("way_tag").where("v = 'forest'").select("way_id").union(v("relation_member").where("type = 'way' AND role = 'inner'").select("ref")).distinct()
    return a.join(v("way_tag").where("v = 'multipolygon'").select("way_id"), "way_id", "left_anti")


@query("SET_05_refresh_marked", "SELECT feature_id, 'old' AS kind FROM {rect} WHERE feature_id % 10 <> 0 UNION ALL SELECT -1 - feature_id, 'new' FROM {rect} WHERE feature_id % 10 = 0")
def _(v):
    old = v("rect").where("NOT feature_id % 10 = 0").select("feature_id", F.lit("old").alias("kind"))
    return old.unionByName(v("rect").where("feature_id % 10 = 0").select((-1 - F.col("feature_id")).alias("feature_id"), F.lit("new").alias("kind")))


@query("WIN_03_dense_ids", "SELECT feature_id, 99 + row_number() OVER (ORDER BY w, h, feature_id) AS new_id FROM {rect} WHERE h > 10")
def _(v):
    return G.dense_ids(v("rect").where("h > 10"), ["w", "h", "feature_id"], 100).select("feature_id", "new_id")


@query("WIN_16_widest_scope", "SELECT k, v, max_by(x0, scope) AS x0 FROM (SELECT k, v, way_id % 1000 AS x0, way_id * 4 + way_id % 3 AS scope FROM {way_tag}) GROUP BY k, v")
def _(v):
    rules = v("way_tag").select("k", "v", (F.col("way_id") % 1000).alias("x0"), (F.col("way_id") * 4 + F.col("way_id") % 3).alias("scope"))
    return rules.groupBy("k", "v").agg(F.max_by("x0", "scope").alias("x0"))


KINDS = "kinds AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS kind FROM (SELECT DISTINCT category FROM {building}))"


def wanted(v):
    from pyspark.sql.window import Window

    kinds = v("building").select("category").distinct().withColumn("kind", F.row_number().over(Window.orderBy("category")) - 1)
    return v("footprint").join(F.broadcast(kinds), "kind")


@query("JOIN_17_category_to_asset", f"WITH {KINDS}, f AS (SELECT category, min(ord) AS ord FROM {{building}} GROUP BY category) SELECT footprint_id AS id, ord FROM {{footprint}} JOIN kinds USING (kind) JOIN f USING (category)")
def _(v):
    rows = wanted(v).select(F.col("footprint_id").alias("id"), "category")
    return G.first_category(v("building"), rows, "PROMO")


@query(
    "JOIN_18_best_match",
    f"""WITH {KINDS}, p AS (SELECT footprint_id, ord, least(a.width, b.width) / CAST(greatest(a.width, b.width) AS DOUBLE) AS ww, least(a.depth, b.depth) / CAST(greatest(a.depth, b.depth) AS DOUBLE) AS dd, least(a.width, b.depth) / CAST(greatest(a.width, b.depth) AS DOUBLE) AS wd, least(a.depth, b.width) / CAST(greatest(a.depth, b.width) AS DOUBLE) AS dw
 FROM {{footprint}} a JOIN kinds USING (kind) JOIN {{building}} b ON b.category = kinds.category AND b.region = 'EU'),
q AS (SELECT footprint_id, ord, CASE WHEN ww >= 1 - 0.3e0 AND dd >= 1 - 0.3e0 THEN 100 + 80 * (ww + dd) / 2 END AS pl, CASE WHEN wd >= 1 - 0.3e0 AND dw >= 1 - 0.3e0 THEN 100 + 80 * (wd + dw) / 2 END AS tu FROM p),
r AS (SELECT *, greatest(coalesce(pl, 0), coalesce(tu, 0)) AS sc, coalesce(tu, 0) > coalesce(pl, 0) AS turned FROM q WHERE pl IS NOT NULL OR tu IS NOT NULL)
SELECT footprint_id, ord, round(sc, 6) AS score, turned FROM r QUALIFY row_number() OVER (PARTITION BY footprint_id ORDER BY sc DESC, ord) = 1""",
)
def _(v):
    return G.best_match(wanted(v).select("footprint_id", "category", "width", "depth"), v("building").where("region = 'EU'"), 0.3)


@query("JOIN_23_nearest_pole", "SELECT a.footprint_id AS left_id, arg_min(n.node_id, ((a.x - n.x) * (a.x - n.x) + (a.y - n.y) * (a.y - n.y), n.node_id)) AS right_id, min((a.x - n.x) * (a.x - n.x) + (a.y - n.y) * (a.y - n.y)) AS d2 FROM {footprint} a JOIN {node} n ON abs(a.x - n.x) <= 64 AND abs(a.y - n.y) <= 64 JOIN {node_tag} t ON t.node_id = n.node_id AND t.v = 'pole' WHERE (a.x - n.x) * (a.x - n.x) + (a.y - n.y) * (a.y - n.y) <= 4096 GROUP BY a.footprint_id")
def _(v):
    poles = v("node").join(v("node_tag").where("v = 'pole'"), "node_id").select(F.col("node_id").alias("right_id"), "x", "y")
    return G.nearest_within(v("footprint").select(F.col("footprint_id").alias("left_id"), "x", "y"), poles, 64, 64)


NEAR = """g AS (SELECT way_id, seq AS seg, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM {way_pt} WINDOW w AS (PARTITION BY way_id ORDER BY seq)),
d AS (SELECT footprint_id AS point_id, way_id, seg, round(pow(x - x1 - t * (x2 - x1), 2) + pow(y - y1 - t * (y2 - y1), 2), 6) AS d2 FROM (SELECT *, CASE WHEN x1 = x2 AND y1 = y2 THEN 0e0 ELSE greatest(0e0, least(1e0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / CAST((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS DOUBLE))) END AS t FROM {footprint} JOIN g ON x2 IS NOT NULL AND x BETWEEN least(x1, x2) - 100 AND greatest(x1, x2) + 100 AND y BETWEEN least(y1, y2) - 100 AND greatest(y1, y2) + 100)),
n AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d2, way_id, seg) AS k FROM d WHERE d2 <= 10000)"""


def near(v, top):
    segs = C.segments(v("way_pt"))
    points = v("footprint").select(F.col("footprint_id").alias("point_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    return G.nearest_segments(points, segs, 100, 256, top)


@query("JOIN_20_nearest_segment", f"WITH {NEAR} SELECT point_id, way_id, seg, d2 FROM n WHERE k = 1")
def _(v):
    return near(v, 1).drop("k")


@query("TOP_04_six_nearest", f"WITH {NEAR} SELECT point_id, way_id, seg, d2, k FROM n WHERE k <= 6")
def _(v):
    return near(v, 6).withColumn("k", F.col("k").cast("long"))


@query("JOIN_24_pole_links", "WITH s AS (SELECT way_id, node_id AS pole, lead(node_id) OVER (PARTITION BY way_id ORDER BY seq) AS nxt, 1 + node_id % 5 AS radius FROM {way_node}) SELECT least(pole, nxt) AS a, greatest(pole, nxt) AS b, max(radius) AS radius FROM s WHERE nxt IS NOT NULL AND nxt <> pole GROUP BY 1, 2")
def _(v):
    return L.links(v("way_node").select("way_id", "seq", F.col("node_id").alias("pole"), (1 + F.col("node_id") % 5).alias("radius")))


@query("WIN_17_pole_sequence", "WITH s AS (SELECT way_id, seq, node_id DIV 50 AS pole, lag(node_id DIV 50) OVER (PARTITION BY way_id ORDER BY seq) AS before FROM {way_node}) SELECT way_id, seq, pole FROM s WHERE before IS NULL OR before <> pole")
def _(v):
    rows = v("way_node").select("way_id", "seq", F.expr("node_id div 50").alias("pole"))
    before = F.lag("pole").over(L.by_way())
    return rows.withColumn("before", before).where("before IS NULL OR before <> pole").drop("before")


@query("WIN_11_consecutive_duplicates", "WITH s AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM (SELECT way_id, seq, x DIV 40 AS x, y DIV 40 AS y FROM {way_pt}) WINDOW w AS (PARTITION BY way_id ORDER BY seq)) SELECT way_id, seq, x, y FROM s WHERE px IS NULL OR px <> x OR py <> y")
def _(v):
    return L.without_repeats(v("way_pt").select("way_id", "seq", F.expr("x div 40").alias("x"), F.expr("y div 40").alias("y")))


@query("WIN_04_resample", f"WITH {SEG} SELECT way_id, CAST(greatest(1, ceil(total / 7.5e0)) AS BIGINT) + 1 AS stations FROM tot")
def _(v):
    return L.stations(v("way_pt"), 7.5).groupBy("way_id").agg(F.count("*").alias("stations"))


@query("WIN_05_fixed_step", f"WITH {SEG} SELECT way_id, CAST(greatest(1, ceil(total / 10e0)) AS BIGINT) AS last_station, round(total, 5) AS d FROM tot")
def _(v):
    done = L.stations(v("way_pt"), 10.0, keep_last=True)
    return done.groupBy("way_id").agg(F.max("station").alias("last_station"), F.round(F.max("d"), 5).alias("d"))


@query("WIN_06_inserted_points", "WITH s AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM {way_pt} WINDOW w AS (PARTITION BY way_id ORDER BY seq)) SELECT way_id, seq, k.range AS k, CAST(trunc(x + (x2 - x) * k.range / 4e0) AS BIGINT) AS px, CAST(trunc(y + (y2 - y) * k.range / 4e0) AS BIGINT) AS py FROM s, range(4) k WHERE x2 IS NOT NULL UNION ALL SELECT way_id, seq, 0, x, y FROM s WHERE x2 IS NULL")
def _(v):
    return L.inserted(v("way_pt"), 3).withColumn("k", F.col("k").cast("long"))


@query("WIN_07_turn_tests", f"WITH {SEG}, t AS (SELECT *, (x2 - x) * lag(x2 - x) OVER v + (y2 - y) * lag(y2 - y) OVER v AS dot, lag(length) OVER v AS before FROM s WHERE length > 0 WINDOW v AS (PARTITION BY way_id ORDER BY seq)) SELECT way_id, coalesce(bool_or(round(degrees(acos(greatest(-1e0, least(1e0, dot / (length * before))))), 6) > 30), false) AS sharp, bool_or(length > 30) AS sparse FROM t GROUP BY way_id")
def _(v):
    return L.turns(v("way_pt"), 30.0, 20.0)


@query("WIN_08_perpendicular", "WITH s AS (SELECT way_id, seq, CAST(coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS DOUBLE) AS dx, CAST(coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS DOUBLE) AS dy FROM {way_pt} WINDOW w AS (PARTITION BY way_id ORDER BY seq)) SELECT way_id, seq, round(CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE -dy / sqrt(dx * dx + dy * dy) END, 6) AS nx, round(CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE dx / sqrt(dx * dx + dy * dy) END, 6) AS ny FROM s")
def _(v):
    return L.perpendiculars(v("way_pt")).select("way_id", "seq", F.round("nx", 6).alias("nx"), F.round("ny", 6).alias("ny"))


@query("WIN_09_cumulative_distance", f"WITH {SEG} SELECT way_id, seq, round((sum(length) OVER (PARTITION BY way_id ORDER BY seq ROWS UNBOUNDED PRECEDING) - length) / 10, 5) AS v FROM s")
def _(v):
    return L.measured(v("way_pt")).select("way_id", "seq", F.round(F.col("start") / 10, 5).alias("v"))


@query("WIN_10_long_line_parts", f"WITH {SEG}, n AS (SELECT *, CAST(greatest(1, ceil(total / 60e0)) AS BIGINT) AS n FROM tot) SELECT way_id, p.range AS part, round(p.range * total / n, 5) AS from_d, round((p.range + 1) * total / n, 5) AS to_d FROM n, range(40) p WHERE p.range < n")
def _(v):
    return L.parts(v("way_pt"), 60.0).select("way_id", "part", F.round("from_d", 5).alias("from_d"), F.round("to_d", 5).alias("to_d"))


@query("WIN_18_both_directions", "WITH c AS (SELECT *, count(*) OVER (PARTITION BY way_id) AS n FROM {way_pt}) SELECT way_id, 'original' AS variant, seq, x, y FROM c UNION ALL SELECT way_id, 'reversed', n - 1 - seq, x, y FROM c")
def _(v):
    return L.both_directions(v("way_pt"))


@query("AGG_19_polygon_measures", f"WITH {RING}, s AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM ring WINDOW w AS (PARTITION BY feature_id ORDER BY seq)) SELECT feature_id, CAST(sum(x * y2 - x2 * y) AS BIGINT) AS area2, round(sum(sqrt(CAST((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y) AS DOUBLE))), 6) AS perimeter, CAST(trunc(avg(x)) AS BIGINT) AS cx, CAST(trunc(avg(y)) AS BIGINT) AS cy FROM s GROUP BY feature_id")
def _(v):
    return L.ring_measures(rings(v), "feature_id").withColumn("perimeter", F.round("perimeter", 6))


@query("AGG_20_min_area_rectangle", "SELECT feature_id, greatest(w, h) AS width, least(w, h) AS depth FROM {rect}")
def _(v):
    # a ring is one row: its edges and what lies along them need no join and no further shuffle
    ring = rings(v).groupBy("feature_id").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    side = lambda p, q: F.struct(p["seq"].alias("edge"), (q["x"] - p["x"]).alias("ex"), (q["y"] - p["y"]).alias("ey"))
    edges = F.filter(F.zip_with(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p") - 1), side), lambda e: (e["ex"] != 0) | (e["ey"] != 0))
    n = lambda e: F.sqrt((e["ex"] * e["ex"] + e["ey"] * e["ey"]).cast("double"))
    units = ring.select("feature_id", "p", F.transform(edges, lambda e: F.struct(e["edge"].alias("edge"), (e["ex"] / n(e)).alias("ux"), (e["ey"] / n(e)).alias("uy"))).alias("edges"))
    extent = lambda at: F.array_max(F.transform("p", at)) - F.array_min(F.transform("p", at))
    along = lambda u: F.struct(u["edge"].alias("edge"), extent(lambda c: c["x"] * u["ux"] + c["y"] * u["uy"]).alias("p"), extent(lambda c: c["y"] * u["ux"] - c["x"] * u["uy"]).alias("q"))
    boxes = units.select("feature_id", F.transform("edges", along).alias("boxes"))
    best = boxes.select("feature_id", F.array_min(F.transform("boxes", lambda b: F.struct(F.round(b["p"] * b["q"], 6).alias("area"), b["edge"].alias("edge"), b["p"].alias("p"), b["q"].alias("q")))).alias("m"))
    return best.select("feature_id", F.greatest("m.p", "m.q").cast("long").alias("width"), F.least("m.p", "m.q").cast("long").alias("depth"))


@query("AGG_21_footprint_centre", f"WITH {RING} SELECT feature_id, CAST(trunc(avg(x)) AS BIGINT) AS cx, CAST(trunc(avg(y)) AS BIGINT) AS cy FROM ring GROUP BY feature_id")
def _(v):
    return L.ring_measures(rings(v), "feature_id").select("feature_id", "cx", "cy")


@query("AGG_33_sampling_step", "SELECT greatest(2, least(8, median(1 + node_id % 9))) AS step FROM {node}")
def _(v):
    return v("node").agg(F.greatest(F.lit(2.0), F.least(F.lit(8.0), F.median(1 + F.col("node_id") % 9))).alias("step"))


@query("AGG_35_group_by_texture", "SELECT v AS texture, count(*) AS n FROM {way_tag} WHERE k = 'highway' AND v <> '' GROUP BY v")
def _(v):
    return v("way_tag").where("k = 'highway' AND v <> ''").groupBy(F.col("v").alias("texture")).agg(F.count("*").alias("n"))


@query("AGG_26_timing_rollup", "SELECT session, component, round(sum(seconds), 4) AS seconds FROM {metric} WHERE seconds > 0.001e0 GROUP BY session, component")
def _(v):
    return v("metric").where("seconds > 0.001").groupBy("session", "component").agg(F.round(F.sum("seconds"), 4).alias("seconds"))


@query("AGG_27_log_by_level", "SELECT session, level, count(*) AS n, string_agg(msg, '|' ORDER BY ts, msg) AS msgs FROM {log} GROUP BY session, level")
def _(v):
    ordered = F.array_sort(F.collect_list(F.struct("ts", "msg")))
    return v("log").groupBy("session", "level").agg(F.count("*").alias("n"), F.array_join(F.transform(ordered, lambda x: x["msg"]), "|").alias("msgs"))


@query("AGG_24_counters", "SELECT count(*) AS attempted, count(*) FILTER (w >= 10) AS placed FROM {rect}")
def _(v):
    return v("rect").agg(F.count("*").alias("attempted"), F.count_if(F.col("w") >= 10).alias("placed"))


@query("TOP_02_capped_areas", "SELECT feature_id FROM {rect} WHERE w > 8 ORDER BY feature_id LIMIT 254")
def _(v):
    return v("rect").where("w > 8").orderBy("feature_id").limit(254).select("feature_id")


@query("TOP_05_area_order", "SELECT status, feature_id, row_number() OVER (PARTITION BY status ORDER BY w * h DESC, feature_id) AS rank FROM {rect} QUALIFY rank <= 100")
def _(v):
    from pyspark.sql.window import Window

    order = Window.partitionBy("status").orderBy((F.col("w") * F.col("h")).desc(), "feature_id")
    return v("rect").withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 100").select("status", "feature_id", "rank")
