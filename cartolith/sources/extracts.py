"""Map extracts (XML of nodes, ways and relations) as tables, and tables as extracts.

Each reader is one splittable scan for its own row tag with an explicit schema. Rows
and references whose numbers cannot be read are left out; a missing role is the empty string.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAGS = "tag array<struct<_k string, _v string>>"
NODES = f"_id string, _lat string, _lon string, {TAGS}"
WAYS = f"_id string, nd array<struct<_ref string>>, {TAGS}"
RELATIONS = f"_id string, member array<struct<_type string, _ref string, _role string>>, {TAGS}"


def scan(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """Elements of one kind; `id` is null where it is not a whole number. An extract without such elements gives no rows."""
    rows = spark.read.format("xml").option("rowTag", kind).option("mode", "PERMISSIVE").schema(schema).load(path)
    return rows.withColumn("id", F.col("_id").try_cast("long")).where("id IS NOT NULL")


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """(id, lon, lat)"""
    rows = scan(spark, path, "node", NODES)
    return rows.select("id", F.col("_lon").try_cast("double").alias("lon"), F.col("_lat").try_cast("double").alias("lat")).where("lon IS NOT NULL AND lat IS NOT NULL")


def way_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(way_id, seq, node_id): references in order, numbered from 0 over those that can be read."""
    refs = F.filter(F.transform("nd", lambda r: r["_ref"].try_cast("long")), lambda r: r.isNotNull())
    return scan(spark, path, "way", WAYS).select(F.col("id").alias("way_id"), F.posexplode(refs).alias("seq", "node_id"))


def members(spark: SparkSession, path: str) -> DataFrame:
    """(rel_id, seq, type, ref, role)"""
    named = F.transform("member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].try_cast("long").alias("ref"), F.coalesce(m["_role"], F.lit("")).alias("role")))
    known = F.filter(named, lambda m: m["ref"].isNotNull() & m["type"].isNotNull())
    return scan(spark, path, "relation", RELATIONS).select(F.col("id").alias("rel_id"), F.posexplode(known).alias("seq", "m")).select("rel_id", "seq", "m.type", "m.ref", "m.role")


def tags(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(id, k, v): of a key that an element repeats the last value counts; keys without a name or value are left out."""
    schema = {"node": NODES, "way": WAYS, "relation": RELATIONS}[kind]
    pairs = F.filter(F.transform("tag", lambda t: F.struct(t["_k"].alias("k"), t["_v"].alias("v"))), lambda t: t["k"].isNotNull() & t["v"].isNotNull())
    rows = scan(spark, path, kind, schema).select("id", F.posexplode(pairs).alias("seq", "t")).select("id", "seq", "t.k", "t.v")
    return rows.groupBy("id", "k").agg(F.max_by("v", "seq").alias("v"))


def write(rows: DataFrame, path: str, kind: str) -> None:
    """Write elements (columns as in NODES, WAYS or RELATIONS) as the files of an extract."""
    rows.write.format("xml").option("rootTag", "osm").option("rowTag", kind).mode("append").save(path)


def tag_list(tags: DataFrame, key: str) -> DataFrame:
    """(key, tag): the tags of an element as the list that the writer takes, in the order of their keys."""
    return tags.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("k").alias("_k"), F.col("v").alias("_v")))).alias("tag"))


def primitives(rings: DataFrame, first: int = -1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Polygons (feature_id, ring, seq, x, y; ring 0 is the outer one) as (nodes, way_nodes, members) with negative ids.

    Nodes are shared by coordinates rounded to ten decimals. A polygon without holes is one way; one with holes is a
    way per ring and a relation. Node ids count down in the order of the coordinates, way ids in that of polygon and ring.
    """
    from cartolith.operators.features import dense_ids

    at = rings.select("feature_id", "ring", "seq", F.round("x", 10).alias("x"), F.round("y", 10).alias("y"))
    own = dense_ids(at.select("x", "y").distinct(), ["x", "y"], start=first, down=True).withColumnRenamed("new_id", "node_id")
    ways = dense_ids(at.select("feature_id", "ring").distinct(), ["feature_id", "ring"], start=first, down=True).withColumnRenamed("new_id", "way_id")
    way_nodes = at.join(own, ["x", "y"]).join(ways, ["feature_id", "ring"]).select("way_id", "seq", "node_id")
    holed = ways.where("ring > 0").select("feature_id").distinct()
    role = F.when(F.col("ring") == 0, "outer").otherwise("inner")
    members = ways.join(holed, "feature_id", "left_semi").select(F.col("feature_id").alias("rel_id"), F.col("ring").alias("seq"), F.lit("way").alias("type"), F.col("way_id").alias("ref"), role.alias("role"))
    return own.select("node_id", "x", "y"), way_nodes, members
