"""Queries over extracts, rule lists and catalogues: written from the views, read back by the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cartolith.plans.fixtures import Register
from cartolith.sources import catalogues as K
from cartolith.sources import extracts as E

query = Register()
QUERIES, SQL = query.queries, query.sql


def folder(v, name: str) -> str:
    return f"{v.spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def extract(v, kind: str) -> str:
    """An extract of the views. Every 97th node has no latitude and every 101st one that is no number; every 89th reference of a way is no number."""
    path = folder(v, f"extract-{kind}")
    if kind == "node":
        lat = F.when(F.col("node_id") % 97 == 0, F.lit(None).cast("string")).when(F.col("node_id") % 101 == 0, "north").otherwise(F.col("lat").cast("string"))
        rows = v("node").select(F.col("node_id").alias("_id"), lat.alias("_lat"), F.col("lon").alias("_lon"))
        E.write(rows.join(E.tag_list(v("node_tag"), "node_id").withColumnRenamed("node_id", "_id"), "_id", "left"), path, kind)
    elif kind == "way":
        ref = F.when(F.col("node_id") % 89 == 0, "n/a").otherwise(F.col("node_id").cast("string"))
        refs = v("way_node").groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", ref.alias("_ref")))), lambda r: F.struct(r["_ref"].alias("_ref"))).alias("nd"))
        E.write(refs.join(E.tag_list(v("way_tag"), "way_id"), "way_id", "left").withColumnRenamed("way_id", "_id"), path, kind)
    else:
        role = F.nullif(F.col("role"), F.lit(""))
        each = F.struct("seq", F.col("type").alias("_type"), F.col("ref").alias("_ref"), role.alias("_role"))
        own = v("relation_member").groupBy(F.col("rel_id").alias("_id")).agg(F.array_sort(F.collect_list(each)).alias("m"))
        E.write(own.select("_id", F.transform("m", lambda m: m.dropFields("seq")).alias("member")), path, kind)
    return path


@query("SRC_01_node_scan", "SELECT node_id AS id, round(lon, 7) AS lon, round(lat, 7) AS lat FROM {node} WHERE node_id % 97 <> 0 AND node_id % 101 <> 0")
def _(v):
    return E.nodes(v.spark, extract(v, "node")).select("id", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))


@query("SRC_02_way_scan", "SELECT way_id, row_number() OVER (PARTITION BY way_id ORDER BY seq) - 1 AS seq, node_id FROM {way_node} WHERE node_id % 89 <> 0")
def _(v):
    return E.way_nodes(v.spark, extract(v, "way"))


@query("SRC_02_way_tags", "SELECT way_id AS id, k, v FROM {way_tag} SEMI JOIN {way_node} USING (way_id)")
def _(v):
    return E.tags(v.spark, extract(v, "way"), "way")


@query("SRC_03_relation_scan", "SELECT rel_id, row_number() OVER (PARTITION BY rel_id ORDER BY seq, type, ref, role) - 1 AS seq, type, ref, role FROM {relation_member}")
def _(v):
    return E.members(v.spark, extract(v, "relation"))


@query("SRC_19_polygons_as_primitives", """WITH r AS (SELECT feature_id, x0, y0, w, h, w > 20 AND h > 15 AS holed FROM {rect}), o AS (SELECT unnest([x0, x0 + w, x0 + w, x0]) AS x, unnest([y0, y0, y0 + h, y0 + h]) AS y FROM r), i AS (SELECT unnest([x0 + 2, x0 + 4, x0 + 4, x0 + 2]) AS x, unnest([y0 + 2, y0 + 2, y0 + 4, y0 + 4]) AS y FROM r WHERE holed)
SELECT 'nodes' AS part, count(*) AS n FROM (SELECT * FROM o UNION SELECT * FROM i) UNION ALL SELECT 'refs', 5 * (count(*) + count(*) FILTER (holed)) FROM r UNION ALL SELECT 'ways', count(*) + count(*) FILTER (holed) FROM r UNION ALL SELECT 'members', 2 * count(*) FILTER (holed) FROM r""")
def _(v):
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h")
    ring = lambda no, pts: F.array(*[F.struct(F.lit(no).alias("ring"), F.lit(k).alias("seq"), x.cast("double").alias("x"), y.cast("double").alias("y")) for k, (x, y) in enumerate(pts)])
    outer = ring(0, [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)])
    inner = ring(1, [(x0 + 2, y0 + 2), (x0 + 4, y0 + 2), (x0 + 4, y0 + 4), (x0 + 2, y0 + 4), (x0 + 2, y0 + 2)])
    rings = v("rect").select("feature_id", F.inline(F.when((F.col("w") > 20) & (F.col("h") > 15), F.concat(outer, inner)).otherwise(outer)))
    nodes, way_nodes, members = E.primitives(rings)
    named = {"nodes": nodes, "refs": way_nodes, "ways": way_nodes.select("way_id").distinct(), "members": members}
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n") for part, df in named.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


def listed(v, rows, name: str) -> str:
    """A list of objects as JSON files, a line holding a list of one object, so that no writer needs the whole list."""
    path = folder(v, name)
    rows.select(F.to_json(F.array(F.struct("*")), {"ignoreNullFields": "true"}).alias("value")).write.option("lineSep", "\n").text(path)
    return path


@query("SRC_13_building_catalogue", "SELECT 'b' || ord || '.i3d' AS file, category AS name, CAST(width AS DOUBLE) AS width, CAST(depth AS DOUBLE) AS depth, CASE WHEN ord % 3 = 0 THEN 0 ELSE 1 END AS n_categories, region FROM {building} WHERE ord % 53 <> 0")
def _(v):
    file = F.when(F.col("ord") % 53 != 0, F.concat(F.lit("b"), F.col("ord"), F.lit(".i3d")))
    rows = v("building").select(file.alias("file"), F.col("category").alias("name"), "width", "depth", F.when(F.col("ord") % 3 != 0, F.array("category")).alias("categories"), F.array("region").alias("regions"))
    return K.buildings(v.spark, listed(v, rows, "buildings")).select("file", "name", "width", "depth", F.size("categories").alias("n_categories"), F.get("regions", 0).alias("region"))


@query("SRC_14_power_assets", "SELECT 'p' || asset_id AS file, name, CASE WHEN asset_id % 2 = 0 THEN 'default' ELSE 'pole' END AS category, CASE WHEN asset_id % 3 = 2 THEN 1 ELSE 2 END AS n_connectors, CASE WHEN asset_id % 3 = 0 THEN 0e0 WHEN asset_id % 3 = 1 THEN 3e0 ELSE 15e-1 END AS sides, CASE WHEN asset_id % 3 = 0 THEN 20e0 WHEN asset_id % 3 = 1 THEN 19e0 ELSE 9e0 END AS heights, CASE WHEN asset_id % 5 > 0 THEN asset_id / 2e0 END AS snap_to_road FROM {asset} WHERE asset_id % 59 <> 0")
def _(v):
    no = F.col("asset_id")
    wire = lambda side, height: F.struct(F.lit(side).cast("string").alias("side"), F.lit(height).cast("string").alias("height"))
    given = F.when(no % 3 == 1, F.array(wire("3", "9"), wire(None, None))).when(no % 3 == 2, F.array(wire("1.5", "9"), wire("2", "high")))
    rows = v("asset").select(
        F.concat(F.lit("p"), no).alias("file"), F.when(no % 59 != 0, F.col("name")).alias("name"), F.when(no % 2 == 1, F.array(F.lit("pole"))).alias("categories"), given.alias("connectors"),
        F.when(no % 5 > 0, (no / 2).cast("string")).otherwise("wide").alias("snap_to_road"),
    )
    total = lambda part: F.round(F.aggregate("connectors", F.lit(0.0), lambda a, c: a + c[part]), 6)
    found = K.assets(v.spark, listed(v, rows, "assets"))
    return found.select("file", "name", F.get("categories", 0).alias("category"), F.size("connectors").alias("n_connectors"), total("side").alias("sides"), total("height").alias("heights"), "snap_to_road")


@query("SRC_15_tree_catalogue", "SELECT name, asset_id AS reference_id, CASE WHEN asset_id % 2 = 0 THEN 'broadleaved' END AS leaf_type FROM {asset} WHERE asset_id % 61 <> 0")
def _(v):
    no = F.col("asset_id")
    rows = v("asset").select("name", F.when(no % 61 != 0, no).alias("reference_id"), F.when(no % 2 == 0, "broadleaved").alias("leaf_type"))
    return K.trees(v.spark, listed(v, rows, "trees"))


@query("SRC_11_grid_specs", "SELECT name, CASE WHEN asset_id % 2 = 0 THEN 5e-1 ELSE 1e0 END AS height_multiplier, 1e0 AS width_multiplier, CASE WHEN asset_id % 3 = 0 THEN 3 ELSE 1 END AS channels, 'uint8' AS data_type FROM {asset}")
def _(v):
    no = F.col("asset_id")
    rows = v("asset").select("name", F.when(no % 2 == 0, 0.5).alias("height_multiplier"), F.when(no % 3 == 0, 3).alias("channels"))
    return K.grids(v.spark, listed(v, rows, "grids"))


@query("SRC_10_layer_rules", "SELECT name, CASE WHEN asset_id % 4 = 0 THEN 4 ELSE 1 END AS count, asset_id % 3 = 0 AS any, CASE asset_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'farmland' ELSE 'forest,wood' END AS tag_values, false AS invisible FROM {asset}")
def _(v):
    no = F.col("asset_id")
    tags = F.when(no % 3 == 0, '{"landuse": true}').when(no % 3 == 1, '{"landuse": "farmland"}').otherwise('{"landuse": ["forest", "wood"]}')
    path = folder(v, "layers")
    count = F.when(no % 4 == 0, '"count": 4, ').otherwise("")
    v("asset").select(F.format_string('[{"name": %s, %s"tags": %s}]', F.to_json(F.array("name")).substr(F.lit(2), F.length(F.to_json(F.array("name"))) - 2), count, tags).alias("value")).write.text(path)
    rule = F.element_at("tags", "landuse")
    return K.layers(v.spark, path).select("name", "count", rule["any"].alias("any"), F.array_join(rule["values"], ",").alias("tag_values"), "invisible")
