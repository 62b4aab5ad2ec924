"""Rule lists and catalogues written as JSON, as typed tables.

A list is read with an explicit schema, so that a malformed file or entry gives nulls and
never a new column; entries without their required fields are left out. `custom` overrides
the standard list as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUILDINGS = "file string, name string, width double, depth double, categories array<string>, regions array<string>, type string"
TREES = "name string, reference_id long, leaf_type string"
GRIDS = "name string, height_multiplier double, width_multiplier double, channels int, data_type string"
ASSETS = "file string, name string, categories array<string>, connectors array<struct<side: string, height: string>>, align_to_road string, snap_to_road string"
LAYERS = "name string, count int, tags string, width double, priority int, info_layer string, usage string, invisible boolean, precise_tags string"
#: The two wires (side, height) of an asset without connectors, and what a connector has where one is not given.
WIRES = ((-2.0, 10.0), (2.0, 10.0))
SIDE, HEIGHT = "0.0", "10.0"


def entries(spark: SparkSession, schema: str, standard: str, custom: str | None = None, multi_line: bool = False) -> DataFrame:
    """The entries of a list of objects. A custom list takes the place of the standard one.

    A line holds one object or one list of objects; with multi_line a file is one list over many lines.
    """
    return spark.read.schema(schema).option("multiLine", multi_line).option("mode", "PERMISSIVE").json(custom or standard)


def required(rows: DataFrame, *names: str) -> DataFrame:
    for name in names:
        rows = rows.where(F.col(name).isNotNull() & (F.col(name).cast("string") != ""))
    return rows


def buildings(spark: SparkSession, standard: str, custom: str | None = None, multi_line: bool = False) -> DataFrame:
    """BUILDINGS with empty lists for missing ones."""
    none = F.array().cast("array<string>")
    rows = required(entries(spark, BUILDINGS, standard, custom, multi_line), "file", "name")
    return rows.withColumns({"categories": F.coalesce("categories", none), "regions": F.coalesce("regions", none)})


def trees(spark: SparkSession, standard: str, custom: str | None = None, multi_line: bool = False) -> DataFrame:
    return required(entries(spark, TREES, standard, custom, multi_line), "name", "reference_id")


def grids(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Info-layer grids; multipliers and channels default to 1, the kind of value to uint8. A malformed file gives no rows."""
    rows = required(entries(spark, GRIDS, path, multi_line=multi_line), "name")
    one = {c: F.coalesce(c, F.lit(1)) for c in ("height_multiplier", "width_multiplier", "channels")}
    return rows.withColumns(one | {"data_type": F.coalesce("data_type", F.lit("uint8"))})


def connectors(raw: Column) -> Column:
    """Connectors (side, height), those left out whose numbers cannot be read; two standard wires where none is left."""
    read = lambda c: F.struct(F.coalesce(c["side"], F.lit(SIDE)).try_cast("double").alias("side"), F.coalesce(c["height"], F.lit(HEIGHT)).try_cast("double").alias("height"))
    known = F.filter(F.transform(F.filter(raw, lambda c: c.isNotNull()), read), lambda c: c["side"].isNotNull() & c["height"].isNotNull())
    standard = F.array(*[F.struct(F.lit(side).alias("side"), F.lit(height).alias("height")) for side, height in WIRES])
    return F.when(F.size(known) > 0, known).otherwise(standard)


def assets(spark: SparkSession, standard: str, custom: str | None = None, multi_line: bool = False) -> DataFrame:
    """Power assets: file and name required, the default category and two wires where none are given, distances that can be read."""
    rows = required(entries(spark, ASSETS, standard, custom, multi_line), "file", "name")
    default = F.array(F.lit("default"))
    return rows.withColumns({
        "categories": F.when(F.size("categories") > 0, F.col("categories")).otherwise(default),
        "connectors": connectors(F.col("connectors")),
        "align_to_road": F.col("align_to_road").try_cast("double"),
        "snap_to_road": F.col("snap_to_road").try_cast("double"),
    })


def layers(spark: SparkSession, standard: str, custom: str | None = None, multi_line: bool = False) -> DataFrame:
    """Layer rules; `tags` becomes a map from key to (any, values): true is any value, a string one value, a list its values."""
    rows = required(entries(spark, LAYERS, standard, custom, multi_line), "name")

    def rules(text: Column) -> Column:
        raw = F.from_json(text, "map<string, string>")
        many = lambda v: F.when(v.startswith("["), F.from_json(v, "array<string>")).when(v != "true", F.array(v)).otherwise(F.array().cast("array<string>"))
        return F.transform_values(raw, lambda k, v: F.struct((v == "true").alias("any"), many(v).alias("values")))

    return rows.withColumns({
        "count": F.coalesce("count", F.lit(1)), "invisible": F.coalesce("invisible", F.lit(False)),
        "tags": rules(F.col("tags")), "precise_tags": rules(F.col("precise_tags")),
    })
