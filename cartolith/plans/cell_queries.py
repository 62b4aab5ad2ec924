"""Queries over cell sets: fills, overlays, set algebra, morphology, whole land-cover jobs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartolith.operators import cells as C
from cartolith.plans.fixtures import Register
from cartolith.plans.raster_queries import extent

query = Register()
QUERIES, SQL = query.queries, query.sql

#: All features and ways are moved onto a 256 x 256 frame by their anchors, so that they overlap.
SMALL = "SELECT feature_id, status, x0 % 240 AS x0, y0 % 240 AS y0, w, h FROM {rect}"
PAINTED = f"p AS (SELECT feature_id, status, unnest(range(x0, x0 + w + 1)) AS x, y FROM (SELECT *, unnest(range(y0, y0 + h + 1)) AS y FROM ({SMALL})))"
MASK = "(SELECT x, y FROM {mask})"
ROADS = "SELECT way_id, seq, x - (way_id * 7919) % 3968 + (way_id * 7919) % 3968 % 180 - 24 AS x, y - (way_id * 104729) % 3968 + (way_id * 104729) % 3968 % 180 - 24 AS y FROM {way_pt}"
SEGS = f"g AS (SELECT way_id, seq AS seg, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM ({ROADS}) WINDOW w AS (PARTITION BY way_id ORDER BY seq))"
BAND = """b AS (SELECT way_id, x, y FROM (SELECT *, unnest(range(least(y1, y2) - 2, greatest(y1, y2) + 3)) AS y FROM (SELECT *, unnest(range(least(x1, x2) - 2, greatest(x1, x2) + 3)) AS x FROM g WHERE x2 IS NOT NULL)),
 LATERAL (SELECT CASE WHEN (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) = 0 THEN 0e0 ELSE greatest(0e0, least(1e0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / CAST((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS DOUBLE))) END AS t)
 WHERE pow(x - x1 - t * (x2 - x1), 2) + pow(y - y1 - t * (y2 - y1), 2) <= 4 + 1e-9 GROUP BY ALL)"""


def small(v):
    return v("rect").select("feature_id", "status", (F.col("x0") % 240).alias("x0"), (F.col("y0") % 240).alias("y0"), "w", "h")


def painted(v):
    return C.fill_rectangles(small(v))


def roads(v):
    moved = lambda c, k: (F.col(c) - (F.col("way_id") * k) % 3968 + (F.col("way_id") * k) % 3968 % 180 - 24).alias(c)
    return v("way_pt").select("way_id", "seq", moved("x", 7919), moved("y", 104729))


LAYERS = ("road", "farmland", "forest")


def layered(v):
    """Cells of painted features and road bands with a layer and its rank, once for every layer: farmland before forest before roads."""
    areas = C.rectangle_spans(small(v)).select(F.when(F.col("status") == "F", "farmland").otherwise("forest").alias("layer"), F.when(F.col("status") == "F", 1).otherwise(2).cast("long").alias("rank"), "y", "low", "high")
    bands = C.ribbon_spans(roads(v), 2).select(F.lit("road").alias("layer"), F.lit(0).cast("long").alias("rank"), "y", "low", "high")
    return C.run_cells(C.runs(areas.unionByName(bands), ("layer", "rank")))


LAYERED = f"{PAINTED}, {SEGS}, {BAND}, l AS (SELECT CASE WHEN status = 'F' THEN 'farmland' ELSE 'forest' END AS layer, CASE WHEN status = 'F' THEN 1 ELSE 2 END AS rank, x, y FROM p UNION ALL SELECT 'road', 0, x, y FROM b)"
GRID = "grid AS (SELECT a.range AS x, b.range AS y FROM range(270) a, range(270) b)"


def grid(v, n=270):
    return v.spark.range(n).select(F.col("id").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("y"))


@query("JOB_land_cover_share", f"WITH {LAYERED}, {GRID}, o AS (SELECT x, y, min_by(layer, rank) AS layer FROM l GROUP BY x, y) SELECT coalesce(layer, 'base') AS layer, count(*) AS cells FROM grid LEFT JOIN o USING (x, y) GROUP BY 1")
def _(v):
    """The flagship: which class owns each cell, and how much area each class holds."""
    owned = C.overlay_first(layered(v).where("x BETWEEN 0 AND 269 AND y BETWEEN 0 AND 269"), LAYERS)
    return C.with_base(owned, grid(v), "base").groupBy("layer").agg(F.count("*").alias("cells"))


@query("POLY_01_polygon_fill", "WITH p AS (SELECT feature_id, unnest(range(x0, x0 + w + 1)) AS x, y, x0, w, h, y0 FROM (SELECT *, unnest(range(y0, y0 + h)) AS y FROM {rect})) SELECT feature_id, count(*) AS cells, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy FROM p WHERE NOT (x >= x0 + 1 AND x <= x0 + 2 AND y >= y0 + 1 AND y < y0 + 3) GROUP BY feature_id")
def _(v):
    at = lambda ring, pts: F.array(*[F.struct(F.lit(ring).alias("ring"), F.lit(k).alias("seq"), x.cast("double").alias("x"), y.cast("double").alias("y")) for k, (x, y) in enumerate(pts)])
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h")
    outer = at(0, [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)])
    a, b = x0 + 0.5, x0 + 2.5
    inner = at(1, [(a, y0 + 1), (b, y0 + 1), (b, y0 + 3), (a, y0 + 3), (a, y0 + 1)])
    filled = C.fill_polygons(v("rect").select("feature_id", F.explode(F.concat(outer, inner)).alias("p")).select("feature_id", "p.*"))
    return filled.groupBy("feature_id").agg(F.count("*").alias("cells"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


@query("POLY_02_line_ribbon", f"WITH {SEGS}, {BAND} SELECT way_id, count(*) AS cells, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy FROM b GROUP BY way_id")
def _(v):
    return C.span_sums(C.pieces(C.ribbon_spans(roads(v), 2), ("way_id",), crowded=False), "way_id")


@query("POLY_03_point_disc", "SELECT node_id, x + dx.range AS x, y + dy.range AS y FROM {node}, range(-3, 4) dx, range(-3, 4) dy WHERE dx.range * dx.range + dy.range * dy.range <= 9")
def _(v):
    return C.discs(v("node").select("node_id", "x", "y"), 3)


@query("POLY_04_splitter_width", "SELECT way_id, CASE v WHEN 'motorway' THEN 8.0 WHEN 'primary' THEN 6.0 WHEN 'residential' THEN 4.0 WHEN 'track' THEN 3.0 ELSE 2.0 END AS width FROM {way_tag} WHERE k = 'highway'")
def _(v):
    widths = v.spark.createDataFrame([("motorway", 8.0), ("primary", 6.0), ("residential", 4.0), ("track", 3.0), ("path", 1.5)], "v string, width double")
    return v("way_tag").where("k = 'highway'").join(F.broadcast(widths), "v").select("way_id", F.greatest("width", F.lit(2.0)).alias("width"))


@query("POLY_05_cut_by_lines", f"WITH {PAINTED}, {SEGS}, {BAND} SELECT feature_id, count(*) AS cells FROM p ANTI JOIN b USING (x, y) GROUP BY feature_id")
def _(v):
    return C.cells_left(small(v), C.runs(C.ribbon_spans(roads(v), 2)))


@query("POLY_06_subtract_holes", f"WITH {PAINTED} SELECT feature_id, count(*) AS cells FROM p WHERE status = 'F' AND NOT EXISTS (SELECT 1 FROM p q WHERE q.status = 'O' AND q.feature_id % 3 = 0 AND q.x = p.x AND q.y = p.y) GROUP BY feature_id")
def _(v):
    own = small(v)
    return C.cells_left(own.where("status = 'F'"), C.runs(C.rectangle_spans(own.where("status = 'O' AND feature_id % 3 = 0"))))


@query("JOIN_09_cross_group_holes", f"WITH {PAINTED} SELECT status, count(*) AS cells FROM (SELECT DISTINCT status, x, y FROM p) a WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.status <> a.status AND q.x = a.x AND q.y = a.y) GROUP BY status")
def _(v):
    cells = C.over_rectangles(small(v).select("status", "x0", "y0", "w", "h", F.lit(1).alias("any")), "any", ("status",))
    alone = cells.groupBy("x", "y").agg(F.min("status").alias("status"), F.max("status").alias("other")).where("status = other")
    return alone.groupBy("status").agg(F.count("*").alias("cells"))


@query("WIN_01_first_writer_overlay", f"WITH {LAYERED} SELECT x, y, min_by(layer, rank) AS layer FROM l GROUP BY x, y")
def _(v):
    return C.overlay_first(layered(v), LAYERS)


@query("WIN_02_last_writer_overlay", f"WITH {PAINTED}, {GRID} SELECT x, y, coalesce(max(feature_id), 255) AS id FROM grid LEFT JOIN p USING (x, y) GROUP BY x, y")
def _(v):
    last = C.overlay_last(painted(v), "feature_id")
    return grid(v).join(last, ["x", "y"], "left").select("x", "y", F.coalesce("feature_id", F.lit(255)).alias("id"))


@query("WIN_14_first_claim", f"WITH {SEGS}, {BAND}, s AS (SELECT *, count(*) OVER (PARTITION BY way_id) AS area FROM b) SELECT x, y, arg_max(way_id, (area, -way_id)) AS way_id FROM s GROUP BY x, y")
def _(v):
    # spans are dealt by their way, so they become pieces and are summed without a shuffle
    own = C.pieces(C.ribbon_spans(roads(v), 2), ("way_id",), crowded=False)
    area = F.sum(F.col("high") - F.col("low") + 1).over(Window.partitionBy("way_id"))
    claims = own.select("y", "low", "high", C.ranked(area, F.col("way_id")).alias("claim"))
    return C.run_cells(C.strongest(claims, "claim")).select("x", "y", C.ranked_id(F.col("claim")).alias("way_id"))


@query("WIN_15_disjoint_surface", f"WITH {PAINTED}, s AS (SELECT *, count(*) OVER (PARTITION BY feature_id) AS area FROM p), o AS (SELECT x, y, arg_max(feature_id, (area, -feature_id)) AS feature_id FROM s GROUP BY x, y) SELECT feature_id, count(*) AS cells FROM o GROUP BY feature_id")
def _(v):
    claims = small(v).select("x0", "y0", "w", "h", C.ranked((F.col("w") + 1) * (F.col("h") + 1), F.col("feature_id")).alias("claim"))
    return C.over_rectangles(claims, "claim").groupBy(C.ranked_id(F.col("claim")).alias("feature_id")).agg(F.count("*").alias("cells"))


@query("SET_02_cell_algebra", f"WITH {PAINTED}, a AS (SELECT DISTINCT x, y FROM p WHERE status = 'F'), b AS (SELECT DISTINCT x, y FROM p WHERE status = 'O') SELECT 'and' AS op, count(*) AS n FROM a SEMI JOIN b USING (x, y) UNION ALL SELECT 'or', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'not', count(*) FROM a ANTI JOIN b USING (x, y)")
def _(v):
    a, b = painted(v).where("status = 'F'"), painted(v).where("status = 'O'")
    named = [(C.intersection(a, b), "and"), (C.union(a, b), "or"), (C.difference(a.select("x", "y").distinct(), b), "not")]
    out = [df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n") for df, op in named]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SET_03_saturating_add", f"WITH {PAINTED} SELECT x, y, CAST(least(255, sum(100)) AS BIGINT) AS v FROM p GROUP BY x, y")
def _(v):
    return C.saturating_sum(painted(v).select("x", "y", F.lit(100).alias("v")))


@query("SET_06_border_transfer", f"WITH {LAYERED}, o AS (SELECT x, y, min_by(layer, rank) AS layer FROM l GROUP BY x, y) SELECT CASE WHEN x < 10 OR y < 10 OR x >= 246 OR y >= 246 THEN 'base' ELSE layer END AS layer, count(*) AS cells FROM o GROUP BY 1")
def _(v):
    return C.border_transfer(C.overlay_first(layered(v), LAYERS), 256, 10, "base").groupBy("layer").agg(F.count("*").alias("cells"))


@query("RAS_24_dissolve", f"WITH {PAINTED} SELECT part, count(*) AS cells FROM (SELECT DISTINCT x, y, (x * 73856093 + y * 19349663 + 7) % 2147483647 % 3 AS part FROM p) GROUP BY part")
def _(v):
    return C.dissolved(painted(v).select("x", "y").distinct(), 3, 7).groupBy("part").agg(F.count("*").alias("cells"))


@query("AGG_31_procedural_masks", f"WITH {LAYERED}, s AS (SELECT * FROM (VALUES ('farmland', 'green'), ('forest', 'green'), ('road', 'grey'), ('farmland', 'fields')) s(layer, mask)) SELECT mask, count(*) AS cells FROM (SELECT DISTINCT mask, x, y FROM l JOIN s USING (layer)) GROUP BY mask")
def _(v):
    sources = v.spark.createDataFrame([("farmland", "green"), ("forest", "green"), ("road", "grey"), ("farmland", "fields")], "layer string, mask string")
    return C.procedural(layered(v), sources).groupBy("mask").agg(F.count("*").alias("cells"))


@query("RAS_04_dilation", "SELECT DISTINCT x + dx.range AS x, y + dy.range AS y FROM {mask}, range(-1, 2) dx, range(-1, 2) dy WHERE x + dx.range BETWEEN 0 AND 63 AND y + dy.range BETWEEN 0 AND 499")
def _(v):
    return C.dilated(v("mask"), 1, *extent(v))


@query("RAS_03_erosion", "SELECT y, x FROM {soil} s WHERE class <> 3 AND NOT EXISTS (SELECT 1 FROM {soil} q WHERE q.class = 3 AND abs(q.x - s.x) <= 1 AND q.y BETWEEN s.y - 1 AND s.y + 1)")
def _(v):
    return C.eroded(v("soil").where("class <> 3"), 1, *extent(v))


@query("POLY_09_inset", "WITH p AS (SELECT feature_id, x0 + 1 AS a, x0 + w - 1 AS b, y0 + 1 AS c, y0 + h - 1 AS d FROM {rect}) SELECT feature_id, (b - a + 1) * (d - c + 1) AS cells FROM p")
def _(v):
    return C.eroded_sizes(v("rect"), 1, 8192, 8192).where("cells > 0").select("feature_id", "cells")


@query("RAS_08_edge_rim", "WITH d AS (SELECT DISTINCT x + dx.range AS x, y + dy.range AS y FROM {soil}, range(-1, 2) dx, range(-1, 2) dy WHERE class = 0 AND x + dx.range BETWEEN 0 AND 63 AND y + dy.range BETWEEN 0 AND 499), e AS (SELECT y, x FROM {soil} s WHERE class = 0 AND NOT EXISTS (SELECT 1 FROM {soil} q WHERE q.class <> 0 AND abs(q.x - s.x) <= 1 AND q.y BETWEEN s.y - 1 AND s.y + 1)) SELECT x, y FROM d ANTI JOIN e USING (x, y)")
def _(v):
    own = v("soil").where("class = 0")
    size = extent(v)
    return C.difference(C.dilated(own, 1, *size), C.eroded(own, 1, *size))


@query("POLY_10_opening", "WITH e AS (SELECT y, x FROM {soil} s WHERE class <> 3 AND NOT EXISTS (SELECT 1 FROM {soil} q WHERE q.class = 3 AND abs(q.x - s.x) <= 1 AND q.y BETWEEN s.y - 1 AND s.y + 1)) SELECT DISTINCT x + dx.range AS x, y + dy.range AS y FROM e, range(-1, 2) dx, range(-1, 2) dy WHERE x + dx.range BETWEEN 0 AND 63 AND y + dy.range BETWEEN 0 AND 499")
def _(v):
    own = v("soil").where("class <> 3")
    size = extent(v)
    return C.dilated(C.eroded(own, 1, *size), 1, *size).join(own.select("x", "y"), ["x", "y"], "left_semi")


@query("SRC_12_zero_grid", "SELECT a.range AS x, b.range AS y, 0 AS v FROM range(135) a, range(135) b")
def _(v):
    return grid(v, int(270 * 0.5)).withColumn("v", F.lit(0))


@query("JOIN_08_spatial_bounds_join", "SELECT DISTINCT a.feature_id FROM {rect} a JOIN {rect} b ON a.status = 'F' AND b.status = 'O' AND a.x0 <= b.x0 + b.w AND a.x0 + a.w >= b.x0 AND a.y0 <= b.y0 + b.h AND a.y0 + a.h >= b.y0")
def _(v):
    tiled = v("rect").withColumn("tx", F.explode(F.sequence(F.expr("x0 div 64"), F.expr("(x0 + w) div 64")))).withColumn("ty", F.explode(F.sequence(F.expr("y0 div 64"), F.expr("(y0 + h) div 64"))))
    a, b = tiled.where("status = 'F'").alias("a"), tiled.where("status = 'O'").alias("b")
    meets = F.expr("a.tx = b.tx AND a.ty = b.ty AND a.x0 <= b.x0 + b.w AND a.x0 + a.w >= b.x0 AND a.y0 <= b.y0 + b.h AND a.y0 + a.h >= b.y0")
    return a.join(b, meets, "left_semi").select("feature_id").distinct()
