"""Asset files: folder scans and sizes read from scene nodes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Margins around lights and shapes, sane ranges, names of details, bands of viewing distances, sizes by kind.
LIGHT_MARGIN, SHAPE_MARGIN = (2.0, 2.0, 3.0), 1.0
SKIPPED = "decal|snow|icicle|small|detail"
BANDS = ((100.0, 50.0, (8.0, 0.1), (6.0, 0.08)), (250.0, 150.0, (12.0, 0.15), (10.0, 0.12)), (float("inf"), 250.0, (25.0, 0.08), (20.0, 0.06)))
KINDS = (("fire", (15.0, 2.0), (12.0, 1.5), 6.0), ("garage", (8.0, 1.0), (6.0, 0.8), 3.5), ("", (10.0, 1.5), (8.0, 1.2), 4.5))


def files(spark: SparkSession, folder: str, extensions: tuple[str, ...], deny: tuple[str, ...] = ()) -> DataFrame:
    """(folder, name, length, modified): files one level below a folder with an allowed extension and no denied text in their name.

    Only the listing is read: the files' content is not a column.
    """
    found = spark.read.format("binaryFile").load(f"{folder}/*/*").select("path", "length", F.col("modificationTime").alias("modified"))
    parts = F.split(F.regexp_replace("path", r"^\w+:/+", ""), "/")
    depth = len(re.sub(r"^\w+:/+|^/+", "", folder.rstrip("/")).split("/"))
    rows = found.where(F.size(parts) == depth + 2).select(F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"), "length", "modified")
    low = F.lower("name")
    allowed = F.concat(F.lit("."), F.element_at(F.split(low, r"\."), -1)).isin(*[e.lower() for e in extensions]) & low.contains(".")
    denied = [low.contains(d.lower()) for d in deny]
    for bad in denied:
        allowed = allowed & ~bad
    return rows.where(allowed)


def translation(text: Column) -> Column:
    """Three numbers of a text, as an array; zeros where it is missing or not three numbers."""
    parts = F.transform(F.split(F.trim(F.coalesce(text, F.lit("0 0 0"))), r"\s+"), lambda p: p.try_cast("double"))
    whole = (F.size(parts) >= 3) & ~F.exists(F.slice(parts, 1, 3), lambda p: p.isNull())
    return F.when(whole, F.slice(parts, 1, 3)).otherwise(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))


def sizes(nodes: DataFrame, digits: int = 1) -> DataFrame:
    """(file, width, depth, height, area, source): sizes of assets from their scene nodes, by the first way that gives one, rounded to digits.

    nodes = (file, root_name, tag, name, translation, clip_distance, lod_distance, hidden), one row per node. In order:
    the box of two lights or more with a margin, if sane; the envelope of three places or more of shapes (no details, not
    at zero) and lights; bands of the largest viewing distance; an estimate by the number of shapes. Files without any
    of these have nulls.
    """
    name = F.lower(F.coalesce("name", F.lit("")))
    light, shape = F.col("tag") == "Light", F.col("tag") == "Shape"
    at = translation(F.col("translation"))
    rows = nodes.withColumn("at", at).withColumn("low", name)
    zero = (F.col("at")[0] == 0) & (F.col("at")[1] == 0) & (F.col("at")[2] == 0)
    placed = light | (shape & ~F.col("low").rlike(SKIPPED) & ~zero)
    lod = F.transform(F.split(F.trim("lod_distance"), r"\s+"), lambda p: p.try_cast("double"))
    lod = F.when((F.size(lod) >= 2) & ~F.exists(lod, lambda p: p.isNull()), F.get(lod, F.lit(1)))
    span = lambda own, axis: F.max(F.when(own, F.col("at")[axis])) - F.min(F.when(own, F.col("at")[axis]))
    collision = (F.coalesce("hidden", F.lit("")) == "true") | F.col("low").contains("col")
    window = shape & ~collision & F.col("low").rlike("window|glass")
    door = shape & ~collision & ~F.col("low").rlike("window|glass") & F.col("low").contains("door")
    g = rows.groupBy("file").agg(
        F.lower(F.coalesce(F.max("root_name"), F.lit(""))).alias("root"), F.count_if(light).alias("lights"), F.count_if(placed).alias("places"), F.count_if(shape).alias("shapes"), F.count_if(window | door).alias("openings"),
        F.greatest(F.max(F.col("clip_distance").try_cast("double")), F.max(lod)).alias("far"), *[span(own, k).alias(f"{n}{k}") for n, own in (("l", light), ("s", placed)) for k in range(3)],
    )
    between = lambda c, a, b: c.between(F.lit(a), F.lit(b))
    box = lambda w, d, h, source: F.struct(w.alias("w"), d.alias("d"), h.alias("h"), F.lit(source).alias("source"))
    lw, ld, lh = F.col("l0") + LIGHT_MARGIN[0], F.col("l2") + LIGHT_MARGIN[1], F.col("l1") + LIGHT_MARGIN[2]
    lights = F.when((F.col("lights") >= 2) & between(lw, 3.0, 200.0) & between(ld, 3.0, 200.0) & between(lh, 2.0, 50.0), box(lw, ld, lh, "light_analysis"))
    sw, sd, sh = (F.col(f"s{k}") + SHAPE_MARGIN for k in (0, 2, 1))
    envelope = F.when((F.col("places") >= 3) & between(sw, 2.0, 200.0) & between(sd, 2.0, 200.0), box(sw, sd, sh, "shape_envelope"))
    clamp = lambda c, a, b: F.greatest(F.lit(a), F.least(F.lit(b), c))

    def band(k: int) -> Column:
        found = None
        for top, base, *rule in BANDS:
            value = rule[k][0] + (F.col("far") - base) * rule[k][1]
            found = F.when(F.col("far") <= top, value) if found is None else found.when(F.col("far") <= top, value)
        return found

    tall = F.when(F.col("root").contains("fire"), 6.0).when(F.col("root").contains("garage"), 3.5).otherwise(4.0)
    far = F.when(F.col("far").isNotNull(), box(clamp(band(0), 4.0, 80.0), clamp(band(1), 3.0, 60.0), tall, "distance_hints"))
    pick = lambda rule: F.coalesce(*[F.when(F.col("root").contains(word), rule(k)) for k, (word, *_) in enumerate(KINDS)])
    more = F.col("shapes") / 10.0
    second = F.col("root").contains("garage") & ~F.col("root").contains("fire") & F.col("root").contains("02")
    wide = pick(lambda k: KINDS[k][1][0] + more * KINDS[k][1][1]) * F.when(second, 1.2).otherwise(1.0) + F.col("openings") * 0.5
    deep = pick(lambda k: KINDS[k][2][0] + more * KINDS[k][2][1]) * F.when(second, 1.1).otherwise(1.0) + F.col("openings") * 0.5 * 0.7
    count = F.when(F.col("shapes") > 0, box(clamp(wide, 4.0, 50.0), clamp(deep, 3.0, 40.0), clamp(pick(lambda k: F.lit(KINDS[k][3])), 2.5, 12.0), "shape_analysis"))
    best = g.select("file", F.coalesce(lights, envelope, far, count).alias("b"))
    return best.select("file", *[F.round(f"b.{c}", digits).alias(n) for c, n in (("w", "width"), ("d", "depth"), ("h", "height"))], F.round(F.col("b.w") * F.col("b.d"), digits).alias("area"), F.col("b.source").alias("source"))
