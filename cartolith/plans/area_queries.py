"""Queries over areas: gaps, connected parts, narrow bridges, insets, slivers, ribbons and the whole clean-up.

Areas lie on the whole frame, so cells grow with the features. Parts of unions of rectangles have SQL by the graph
of rectangles that share an edge; where cells are split or eroded inside parts, SQL would need components of cells
and is left out (tested against flood fill).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolith.operators import areas as A
from cartolith.operators import cells as C
from cartolith.plans.fixtures import Register

query = Register()
QUERIES, SQL = query.queries, query.sql

CELLS = "p AS (SELECT DISTINCT status, x, y FROM (SELECT *, unnest(range(x0, x0 + w + 1)) AS x FROM (SELECT *, unnest(range(y0, y0 + h + 1)) AS y FROM {rect})))"


def areas(v):
    """Cells of all rectangles, in two groups by their status."""
    return C.fill_rectangles(v("rect")).select(F.col("status").alias("group"), "y", "x")


def covered(v):
    """The distinct cells of areas(); equal rectangles are filled once."""
    rects = v("rect").select(F.col("status").alias("group"), "x0", "y0", "w", "h").distinct()
    return C.run_cells(C.pieces(C.rectangle_spans(rects), ("group",))).select("group", "y", "x")


def beds(v, half_width):
    """The distinct cells of all roads' flat ribbons."""
    return C.run_cells(C.pieces(A.flat_ribbon_spans(roads(v), half_width).drop("way_id"))).select("y", "x")


def roads(v):
    """The vertices of all highways; ways are chosen before their vertices are numbered, which is done way by way."""
    ways = v("way_tag").where("k = 'highway'").select(F.col("way_id").alias("l_orderkey"))
    return v.over("way_pt", lineitem=v("lineitem").join(ways, "l_orderkey", "left_semi"))


def obstacles(v):
    """Discs around all poles and towers."""
    poles = v("node").join(v("node_tag").where("k = 'power'").select("node_id"), "node_id", "left_semi")
    return C.discs(poles.select("x", "y"), 2)


def counted(found, *keys):
    return found.groupBy(*keys).agg(F.count("*").alias("cells"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


@query("POLY_07_closed_gaps", f"""WITH {CELLS}, a AS (SELECT DISTINCT status, x + d.range AS x, y FROM p, range(-2, 3) d), b AS (SELECT DISTINCT status, x, y + d.range AS y FROM a, range(-2, 3) d),
c AS (SELECT status, x + d.range AS x, y FROM b, range(-2, 3) d GROUP BY ALL HAVING count(*) = 5), e AS (SELECT status, x, y + d.range AS y FROM c, range(-2, 3) d GROUP BY ALL HAVING count(*) = 5)
SELECT status AS "group", count(*) AS cells, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy FROM e GROUP BY status""")
def _(v):
    return counted(A.merged(covered(v), 2, ("group",)), "group")


#: Rectangles of one status that share cells, or edges of cells, and the smallest first cell that each reaches.
JOINED = """r AS (SELECT *, y0 * 2147483648 + x0 AS first, x0 // 64 AS tx, y0 // 64 AS ty FROM {rect}),
n AS (SELECT a.feature_id AS a, b.feature_id AS b FROM r a JOIN (SELECT r.*, tx + i.range AS bx, ty + j.range AS by FROM r, range(-1, 2) i, range(-1, 2) j) b ON a.status = b.status AND a.tx = b.bx AND a.ty = b.by
 WHERE a.x0 <= b.x0 + b.w + 1 AND b.x0 <= a.x0 + a.w + 1 AND a.y0 <= b.y0 + b.h + 1 AND b.y0 <= a.y0 + a.h + 1 AND ((a.x0 <= b.x0 + b.w AND b.x0 <= a.x0 + a.w) OR (a.y0 <= b.y0 + b.h AND b.y0 <= a.y0 + a.h))),
t AS (SELECT a, b FROM n UNION SELECT t.a, n.b FROM t JOIN n ON n.a = t.b), l AS (SELECT t.a AS feature_id, min(first) AS part FROM t JOIN r ON r.feature_id = t.b GROUP BY t.a)"""


@query("POLY_14_connected_parts", f"""WITH RECURSIVE {JOINED}, c AS (SELECT DISTINCT status, part, x, y FROM (SELECT *, unnest(range(x0, x0 + w + 1)) AS x FROM (SELECT r.*, part, unnest(range(y0, y0 + h + 1)) AS y FROM r JOIN l USING (feature_id))))
SELECT status AS "group", part, count(*) AS cells FROM c GROUP BY ALL HAVING count(*) > 100""")
def _(v):
    found = A.parts(covered(v), ("group",), 100)
    return found.groupBy("group", "part").agg(F.count("*").alias("cells"))


FLAT = """s AS (SELECT way_id, seq, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lag(x) OVER w AS x0 FROM {way_pt} SEMI JOIN (SELECT way_id FROM {way_tag} WHERE k = 'highway') USING (way_id) WINDOW w AS (PARTITION BY way_id ORDER BY seq)),
f AS (SELECT way_id, x, y FROM (SELECT *, unnest(range(least(y1, y2) - 3, greatest(y1, y2) + 4)) AS y FROM (SELECT *, unnest(range(least(x1, x2) - 3, greatest(x1, x2) + 4)) AS x FROM s WHERE x2 IS NOT NULL AND (x1 <> x2 OR y1 <> y2)))
 WHERE (x2 - x1) * (x - x1) + (y2 - y1) * (y - y1) BETWEEN 0 AND (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AND pow((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1), 2) <= 9 * ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))
 UNION SELECT way_id, x1 + i.range, y1 + j.range FROM s, range(-3, 4) i, range(-3, 4) j WHERE x0 IS NOT NULL AND x2 IS NOT NULL AND i.range * i.range + j.range * j.range <= 9)"""


@query("POLY_13_flat_ribbon", f"WITH {FLAT} SELECT way_id, count(*) AS cells, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy FROM f GROUP BY way_id")
def _(v):
    return C.span_sums(C.pieces(A.flat_ribbon_spans(roads(v), 3), ("way_id",), crowded=False), "way_id")


@query("POLY_13_water_parts")
def _(v):
    """Water surfaces: roads stand for streams and the forest group's rectangles for lakes."""
    return counted(A.water_parts(roads(v), covered(v).where("group = 'O'").select("y", "x"), 1), "part")


@query("POLY_15_component_ribbons")
def _(v):
    shared = v("way_node").join(roads(v).select("way_id").distinct(), "way_id", "left_semi").select("way_id", "node_id").distinct()
    # ways of one node are linked to the node's smallest way: the same components, without pairs
    low = shared.groupBy("node_id").agg(F.min("way_id").alias("b"))
    links = shared.join(low, "node_id").select(F.col("way_id").alias("a"), "b").where("a <> b").distinct()
    return C.span_sums(A.component_spans(roads(v), links, 2), "component")


@query("POLY_08_narrow_bridges")
def _(v):
    return counted(A.split_narrow(A.parts(covered(v), ("group",)), 6, ("group",)), "group", "part")


@query("POLY_17_whole_clean_up")
def _(v):
    found = A.cleaned_up(covered(v), beds(v, 2), obstacles(v), split_width=4, merge_distance=6, narrow_width=6, shrink=1, min_cells=20, min_width=2)
    return counted(found, "group", "part")


@query("POLY_18_per_usage")
def _(v):
    """Fields are cut, padded and freed from holes; forests are merged only; the third usage asks for nothing."""
    usage = F.when(F.col("group") == "F", "field").otherwise(F.when(F.col("x") < 2048, "forest").otherwise("meadow"))
    settings = {"field": A.CleanUp(split=True, merge=True, add_holes=True, padding=1, min_cells=20), "forest": A.CleanUp(merge=True, merge_distance=3), "meadow": A.CleanUp()}
    return A.per_usage(areas(v).withColumn("usage", usage), settings, beds(v, 2), obstacles(v))[1]
