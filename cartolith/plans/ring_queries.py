"""Queries over rings: stitched relation members, simplified and rounded rings, meshes without their centre."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolith.operators import raster as R
from cartolith.operators import rings as G
from cartolith.plans.fixtures import Register
from cartolith.plans.raster_queries import extent

query = Register()
QUERIES, SQL = query.queries, query.sql

#: Corners of rectangles and of the holes in large ones, from the first and around.
CORNERS = "o AS (SELECT feature_id, i, x0 + CASE WHEN i IN (1, 2) THEN w ELSE 0 END AS x, y0 + CASE WHEN i IN (2, 3) THEN h ELSE 0 END AS y FROM {rect}, range(4) s(i)), h AS (SELECT feature_id, i, x0 + 2 + CASE WHEN i IN (1, 2) THEN 3 ELSE 0 END AS x, y0 + 2 + CASE WHEN i IN (2, 3) THEN 3 ELSE 0 END AS y FROM {rect}, range(4) s(i) WHERE w > 8 AND h > 8)"


def relations(v):
    """Rectangles as relations of two open outer ways, the second one turned for odd features, and a closed inner way for large ones.

    Returns members, way ends, way nodes and nodes; a node's id is eight times the feature's and the corner's number, holes from 4 on.
    """
    node = lambda n: F.col("feature_id") * 8 + n
    rect = v("rect").withColumn("odd", F.col("feature_id") % 2 == 1)
    large = (F.col("w") > 8) & (F.col("h") > 8)
    second = F.when(F.col("odd"), F.array(node(0), node(3), node(2))).otherwise(F.array(node(2), node(3), node(0)))
    ways = F.array(F.struct(F.lit(0).alias("k"), F.array(node(0), node(1), node(2)).alias("nodes")), F.struct(F.lit(1).alias("k"), second.alias("nodes")), F.struct(F.lit(2).alias("k"), F.when(large, F.array(node(4), node(5), node(6), node(7), node(4))).alias("nodes")))
    rows = rect.select("feature_id", F.inline(ways)).where("nodes IS NOT NULL").withColumn("way_id", F.col("feature_id") * 3 + F.col("k"))
    members = rows.select(F.col("feature_id").alias("rel_id"), "way_id", F.when(F.col("k") == 2, "inner").when(F.col("k") == 1, "").otherwise("outer").alias("role"))
    ends = rows.select("way_id", F.col("nodes")[0].alias("a"), F.element_at("nodes", -1).alias("b"))
    way_nodes = rows.select("way_id", F.posexplode("nodes").alias("seq", "node_id"))
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h")
    places = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0 + 2, y0 + 2), (x0 + 5, y0 + 2), (x0 + 5, y0 + 5), (x0 + 2, y0 + 5)]
    nodes = rect.select(F.inline(F.array(*[F.struct(node(n).alias("node_id"), x.alias("x"), y.alias("y")) for n, (x, y) in enumerate(places)])))
    return members, ends, way_nodes, nodes


def stitched(v):
    members, ends, way_nodes, nodes = relations(v)
    return G.ring_nodes(G.stitched(members, ends), way_nodes), nodes


@query("JOIN_02_relation_rings", f"WITH {CORNERS}, r AS (SELECT feature_id AS rel_id, 'outer' AS role, feature_id * 3 AS ring, i AS seq, x, y FROM o UNION ALL SELECT feature_id, 'inner', feature_id * 3 + 2, i, x, y FROM h) SELECT * FROM r UNION ALL SELECT rel_id, role, ring, 4, x, y FROM r WHERE seq = 0")
def _(v):
    rings, nodes = stitched(v)
    return rings.join(nodes, "node_id").select("rel_id", "role", "ring", "seq", "x", "y")


@query("JOIN_02_relation_areas", "SELECT feature_id AS rel_id, (w + 1) * h - CASE WHEN w > 8 AND h > 8 THEN 12 ELSE 0 END AS cells FROM {rect}")
def _(v):
    return G.relation_cells(*stitched(v)).groupBy("rel_id").agg(F.count("*").alias("cells"))


def rings(v):
    """Ways of four vertices or more as closed rings."""
    own = v("way_pt").withColumn("n", F.expr("count(*) OVER (PARTITION BY way_id)")).where("n >= 4")
    closing = own.where("seq = 0").select(F.col("way_id").alias("ring"), F.col("n").alias("seq"), "x", "y")
    return own.select(F.col("way_id").alias("ring"), "seq", "x", "y").unionByName(closing)


@query("WIN_22_simplified_rings")
def _(v):
    found = G.simplified(rings(v), 6.0)
    return found.groupBy("ring").agg(F.count("*").alias("vertices"), F.round(F.sum(F.col("x") * (F.col("seq") + 1)), 3).alias("sx"), F.round(F.sum("y"), 3).alias("sy"))


@query("WIN_21_rounded_corners", """WITH v AS (SELECT way_id AS ring, seq, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, count(*) OVER (PARTITION BY way_id) AS n FROM {way_pt}),
c AS (SELECT ring, seq, x, y FROM v WHERE n >= 4 UNION ALL SELECT ring, n, x, y FROM v WHERE n >= 4 AND seq = 0),
f AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY ring) AS m FROM (SELECT *, lag(x) OVER w AS lx, lag(y) OVER w AS ly FROM c WINDOW w AS (PARTITION BY ring ORDER BY seq)) WHERE lx IS NULL OR abs(lx - x) > 1e-6 OR abs(ly - y) > 1e-6 WINDOW w AS (PARTITION BY ring ORDER BY seq)),
p AS (SELECT ring, i, m, x, y, coalesce(lag(x) OVER w, last(x) OVER a) AS px, coalesce(lag(y) OVER w, last(y) OVER a) AS py, coalesce(lead(x) OVER w, first(x) OVER a) AS nx, coalesce(lead(y) OVER w, first(y) OVER a) AS ny FROM f WHERE i < m WINDOW w AS (PARTITION BY ring ORDER BY i), a AS (PARTITION BY ring ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
l AS (SELECT *, sqrt(pow(px - x, 2) + pow(py - y, 2)) AS lp, sqrt(pow(nx - x, 2) + pow(ny - y, 2)) AS ln FROM p),
t AS (SELECT *, CASE WHEN lp * ln = 0 THEN 0 ELSE pi() - acos(greatest(-1e0, least(1e0, ((px - x) * (nx - x) + (py - y) * (ny - y)) / (lp * ln)))) END AS turn FROM l),
r AS (SELECT *, least(19 * least(1e0, turn / (pi() / 2)), 45e-2 * lp, 45e-2 * ln) AS reach FROM t), s AS (SELECT *, turn > radians(7e0) AND reach > 25e-2 AND m >= 4 AS corner FROM r), u AS (SELECT *, count(*) FILTER (corner) OVER (PARTITION BY ring) AS corners FROM s)
SELECT ring, CAST(sum(CASE WHEN corner THEN greatest(3, 10 + floor(round(turn / (pi() / 2) * 2, 6))) + 1 ELSE 1 END) AS BIGINT) AS vertices, round(sum(CASE WHEN corner THEN reach ELSE 0 END), 3) AS reach FROM u WHERE corners > 0 GROUP BY ring""")
def _(v):
    """Vertices of the rounded rings of strength 0.5, and the radii of their corners (from the arcs' first points)."""
    own = rings(v).checkpoint()
    found = G.rounded(own, 0.5, control=False)
    counts = found.groupBy("ring").agg((F.count("*") - 1).alias("vertices"))
    corners = G.corners(own, 0.5, control=False).groupBy("ring").agg(F.round(F.sum("r"), 3).alias("reach"))
    return counts.join(corners, "ring").select("ring", "vertices", "reach")


@query("MESH_05_without_centre", """WITH g AS (SELECT max(v) AS hi, max(x) AS mx, max(y) AS my FROM {dem}), q AS (SELECT x, y FROM {dem} WHERE x % 8 = 0 AND y % 8 = 0 AND x + 8 <= 63 AND y + 8 <= 499),
p AS (SELECT greatest(0, least(x + 8 - 32e0, 20) - greatest(x - 32e0, -20)) * greatest(0, least(y + 8 - 250e0, 20) - greatest(y - 250e0, -20)) AS inside FROM q)
SELECT round(sum(64 - inside), 3) AS area FROM p""")
def _(v):
    width, height = extent(v)
    vertices, faces = R.mesh(v("dem"), width, height, 8)
    centred = vertices.withColumn("x", F.col("x") - width // 2).withColumn("y", F.col("y") - height // 2)
    found = G.without_centre(centred, faces, 20.0)
    double = F.abs((F.col("x2") - F.col("x1")) * (F.col("y3") - F.col("y1")) - (F.col("y2") - F.col("y1")) * (F.col("x3") - F.col("x1")))
    return found.agg(F.round(F.sum(double / 2), 3).alias("area"))
