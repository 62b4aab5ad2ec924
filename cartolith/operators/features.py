"""Node, way and relation tables: assembly, closure, pruning, counts, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Keys whose counts are summed together by dense_ids_by_key.
KEYS = 10_000


def way_geometry(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way_id, seq, x, y) of the references that exist, in order."""
    return way_nodes.join(nodes.select("node_id", "x", "y"), "node_id").select("way_id", "seq", "x", "y")


def way_kinds(geometry: DataFrame) -> DataFrame:
    """(way_id, n, kind): polygon with four coordinates or more, line with two distinct ones, else nothing."""
    counts = geometry.groupBy("way_id").agg(F.count("*").alias("n"), F.count_distinct("x", "y").alias("places"))
    return counts.select("way_id", "n", F.when(F.col("n") >= 4, "polygon").when(F.col("places") >= 2, "line").alias("kind")).where("kind IS NOT NULL")


def closure(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, rel_id): every relation reachable from a root through relation members, the root included.

    One join per nesting level; ends as soon as a level adds nothing, so cycles are harmless.
    """
    step = members.where("type = 'relation'").select("rel_id", F.col("ref").alias("child"))
    found = roots.select(F.col("rel_id").alias("root"), "rel_id")
    fresh = found
    while True:
        fresh = fresh.join(step, "rel_id").select("root", F.col("child").alias("rel_id")).distinct().join(found, ["root", "rel_id"], "left_anti")
        fresh = fresh.checkpoint()
        if fresh.isEmpty():
            break
        found = found.unionByName(fresh)
    return found


def reached_ways(members: DataFrame, closed: DataFrame) -> DataFrame:
    """(root, way_id) of all ways of the relations reached."""
    return closed.join(members.where("type = 'way'"), "rel_id").select("root", F.col("ref").alias("way_id")).distinct()


def bounds(points: DataFrame, *keys: str) -> DataFrame:
    return points.groupBy(*keys).agg(F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"))


def usage(members: DataFrame) -> DataFrame:
    """(way_id, n): how many relation memberships a way has."""
    return members.where("type = 'way'").groupBy(F.col("ref").alias("way_id")).agg(F.count("*").alias("n"))


def end_degrees(way_nodes: DataFrame) -> DataFrame:
    """(way_id, round_start, round_end): whether each end node ends no other way."""
    ends = way_nodes.groupBy("way_id").agg(F.min_by("node_id", "seq").alias("a"), F.max_by("node_id", "seq").alias("b"))
    degree = ends.select(F.explode(F.array("a", "b")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("n"))
    starts = degree.select(F.col("node_id").alias("a"), (F.col("n") == 1).alias("round_start"))
    stops = degree.select(F.col("node_id").alias("b"), (F.col("n") == 1).alias("round_end"))
    return ends.join(starts, "a").join(stops, "b").select("way_id", "round_start", "round_end")


def orphans(nodes: DataFrame, tagged: DataFrame, way_nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Untagged nodes that no way and no relation refers to."""
    used = tagged.select("node_id").unionByName(way_nodes.select("node_id")).unionByName(members.where("type = 'node'").select(F.col("ref").alias("node_id")))
    return nodes.join(used, "node_id", "left_anti")


def merged_extracts(extracts: DataFrame) -> DataFrame:
    """One row per (type, id): the one of the first tile."""
    return extracts.groupBy("type", "id").agg(F.min_by("payload", "tile_no").alias("payload"), F.min("tile_no").alias("tile_no"))


def subdivided(points: DataFrame, size: int, limit: int, rounds: int = 10) -> DataFrame:
    """(depth, bx, by, n): boxes of a square halved (longer axis first, x on ties) until none holds over `limit` points.

    Every round counts points per box; only boxes over the limit are split on.
    """
    done: list[DataFrame] = []
    w = h = size
    open_points, shape = points.select("x", "y"), []
    for depth in range(rounds + 1):
        shape.append((w, h))
        boxed = open_points.withColumn("bx", (F.col("x") / w).cast("long")).withColumn("by", (F.col("y") / h).cast("long"))
        counts = boxed.groupBy("bx", "by").agg(F.count("*").alias("n"))
        if depth == rounds:
            done.append(counts.select(F.lit(depth).alias("depth"), "bx", "by", "n"))
            break
        counts = counts.checkpoint()
        done.append(counts.where(F.col("n") <= limit).select(F.lit(depth).alias("depth"), "bx", "by", "n"))
        crowded = counts.where(F.col("n") > limit).select("bx", "by")
        if crowded.isEmpty():
            break
        open_points = boxed.join(F.broadcast(crowded) if depth < 6 else crowded, ["bx", "by"], "left_semi").select("x", "y")
        w, h = (w // 2, h) if w >= h else (w, h // 2)
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def dense_ids(df: DataFrame, order: list[str], start: int = 0, down: bool = False) -> DataFrame:
    """Add `new_id`: consecutive numbers in the given order, without a window over all rows.

    Rows are range-partitioned and numbered inside partitions; partition counts give the offsets.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    numbered = dealt.withColumn("__k", F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1)
    numbered = numbered.checkpoint()
    counts = numbered.groupBy("__part").agg(F.count("*").alias("__n"))
    offsets = counts.withColumn("__base", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).select("__part", "__base")
    number = F.col("__base") + F.col("__k")
    return numbered.join(F.broadcast(offsets), "__part").withColumn("new_id", (F.lit(start) - number if down else F.lit(start) + number).cast("long")).drop("__part", "__k", "__base")


def dense_ids_by_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Add `new_id`: consecutive numbers from 0 in the order of key and `order`; only the counts of the keys are sorted and kept, the rows are shuffled once."""
    counts = dense_ids(df.groupBy(key).agg(F.count("*").alias("__n")), [key])
    # sums of blocks of keys, and within a block
    counts = counts.withColumn("__block", F.expr(f"new_id div {KEYS}")).checkpoint()
    blocks = counts.groupBy("__block").agg(F.sum("__n").alias("__all"))
    blocks = blocks.select("__block", (F.sum("__all").over(Window.orderBy("__block")) - F.col("__all")).alias("__base"))
    within = F.sum("__n").over(Window.partitionBy("__block").orderBy(key)) - F.col("__n")
    bases = counts.withColumn("__within", within).join(F.broadcast(blocks), "__block").select(key, (F.col("__base") + F.col("__within")).alias("__base"))
    number = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return df.join(bases, key).withColumn("new_id", (F.col("__base") + number).cast("long")).drop("__base")


def first_category(entries: DataFrame, wanted: DataFrame, default: str) -> DataFrame:
    """(id, ord): the first catalogue entry of a wanted category, else the first of the default category."""
    first = entries.groupBy("category").agg(F.min("ord").alias("ord"))
    fallback = first.where(F.col("category") == default).agg(F.min("ord").alias("fallback"))
    return wanted.join(F.broadcast(first), "category", "left").crossJoin(F.broadcast(fallback)).select("id", F.coalesce("ord", "fallback").alias("ord"))


def best_match(wanted: DataFrame, entries: DataFrame, tolerance: float) -> DataFrame:
    """(footprint_id, ord, score, turned): the best catalogue entry of the category, in the better of two orientations.

    Both size ratios must reach 1 - tolerance; score = 100 + 80 times their mean; ties keep the unturned
    orientation and the earlier entry.
    """
    # entries of one size are told apart by their number only, and footprints of one size have the same match
    size = ["category", "width", "depth"]
    sizes, kinds = wanted.select(*size).distinct(), entries.groupBy(*size).agg(F.min("ord").alias("ord"))
    both = sizes.alias("a").join(kinds.alias("b"), F.col("a.category") == F.col("b.category"))
    ratio = lambda x, y: F.least(x, y) / F.greatest(x, y)
    w, d, bw, bd = F.col("a.width"), F.col("a.depth"), F.col("b.width"), F.col("b.depth")

    def score(x: Column, y: Column) -> Column:
        rw, rd = ratio(w, x), ratio(d, y)
        return F.when((rw >= 1 - tolerance) & (rd >= 1 - tolerance), 100 + 80 * (rw + rd) / 2)

    plain, turned = score(bw, bd), score(bd, bw)
    own = [F.col(f"a.{c}").alias(c) for c in size]
    rows = both.select(*own, "b.ord", plain.alias("p"), turned.alias("t")).where("p IS NOT NULL OR t IS NOT NULL")
    rows = rows.select(*size, "ord", F.greatest("p", "t").alias("score"), (F.coalesce("t", F.lit(0.0)) > F.coalesce("p", F.lit(0.0))).alias("turned"))
    best = F.max_by(F.struct("ord", "score", "turned"), F.struct("score", -F.col("ord")))
    found = rows.groupBy(*size).agg(best.alias("m"))
    return wanted.select("footprint_id", *size).join(found, size).select("footprint_id", "m.ord", F.round("m.score", 6).alias("score"), "m.turned")


#: Copies of right points, in all and in a bucket, up to which nearest_within hands them to every task.
FEW, FEW_TOGETHER = 200_000, 1024


def nearest_within(left: DataFrame, right: DataFrame, radius: int, bucket: int, ids: tuple[str, ...] = ("left_id",)) -> DataFrame:
    """(*ids, right_id, d2): nearest right point within a radius, ties by the smaller id; buckets as wide as the radius or wider.

    Only distinct places are compared: of right points on one place the smallest id counts. Where these are few, by
    count, every bucket's are broadcast and the left points stay where they are. Otherwise left points on one place
    have the same answer.
    """
    if bucket < radius:
        raise ValueError("buckets must be as wide as the radius")
    cell = lambda c: F.floor(F.col(c) / bucket)
    others = right.groupBy("x", "y").agg(F.min("right_id").alias("right_id"))
    b = others.withColumn("bx", F.explode(F.sequence(cell("x") - 1, cell("x") + 1))).withColumn("by", F.explode(F.sequence(cell("y") - 1, cell("y") + 1)))
    copies, together = b.groupBy("bx", "by").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if copies <= FEW and together <= FEW_TOGETHER:
        # in the order of the ids, so the first of equally near ones counts
        held = b.groupBy("bx", "by").agg(F.array_sort(F.collect_list(F.struct("right_id", "x", "y"))).alias("p")).select("bx", "by", *[F.col(f"p.{c}").alias(f"{c}s") for c in ("right_id", "x", "y")])
        off = lambda c: F.transform(f"{c}s", lambda p: (F.col(c) - p) * (F.col(c) - p))
        found = left.select(*ids, "x", "y", cell("x").alias("bx"), cell("y").alias("by")).join(F.broadcast(held), ["bx", "by"])
        found = found.select(*ids, "right_ids", F.zip_with(off("x"), off("y"), lambda p, q: p + q).alias("d2s")).withColumn("d2", F.array_min("d2s")).where(F.col("d2") <= radius * radius)
        return found.select(*ids, F.element_at("right_ids", F.array_position("d2s", F.col("d2")).cast("int")).alias("right_id"), "d2")
    places = left.select("x", "y").distinct()
    a = places.withColumn("bx", cell("x")).withColumn("by", cell("y"))
    pairs = a.alias("a").join(b.alias("b"), ["bx", "by"])
    dx, dy = F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")
    d2 = dx * dx + dy * dy
    near = pairs.select("a.x", "a.y", F.col("b.right_id"), d2.alias("d2")).where(F.col("d2") <= radius * radius)
    best = near.groupBy("x", "y").agg(F.min(F.struct("d2", "right_id")).alias("m"))
    return left.select(*ids, "x", "y").join(best, ["x", "y"]).select(*ids, "m.right_id", "m.d2")


#: Shares of the radius that nearest_segments tries first, and its narrowest buckets.
REACHES, NARROWEST = (16, 4), 64


def nearest_segments(points: DataFrame, segments: DataFrame, radius: int, bucket: int, top: int = 1) -> DataFrame:
    """(point_id, way_id, seg, d2): the `top` nearest segments within a radius; segments are dealt to every bucket they may be near.

    Points on one place have the same answer, so distinct places are compared; few of them, by count, are broadcast. A place with `top` segments within a
    share of the radius needs no farther ones; the others go on to the next share, up to the radius.
    """
    from cartolith.operators.cells import segment_distance2

    order = Window.partitionBy("px", "py").orderBy("d2", "way_id", "seg")
    open_places, found = points.select("px", "py").distinct().checkpoint(), []
    handed = F.broadcast if open_places.limit(FEW + 1).count() <= FEW else lambda places: places
    for reach in [-(-radius // n) for n in REACHES if radius > 4 * n] + [radius]:
        wide = min(bucket, max(NARROWEST, 2 * reach))
        span = lambda lo, hi: F.sequence(F.floor((lo - reach) / wide), F.floor((hi + reach) / wide))  # noqa: B023, E731
        dealt = segments.withColumn("bx", F.explode(span(F.least("x1", "x2"), F.greatest("x1", "x2")))).withColumn("by", F.explode(span(F.least("y1", "y2"), F.greatest("y1", "y2"))))
        a = open_places.withColumn("bx", F.floor(F.col("px") / wide)).withColumn("by", F.floor(F.col("py") / wide))
        near = dealt.join(handed(a), ["bx", "by"]).withColumn("d2", F.round(segment_distance2(F.col("px"), F.col("py")), 6)).where(F.col("d2") <= reach * reach)
        best = near.select("px", "py", "way_id", "seg", "d2").withColumn("k", F.row_number().over(order)).where(F.col("k") <= top)
        if reach == radius:
            found.append(best)
            break
        best = best.checkpoint()
        whole = best.where(F.col("k") == top).select("px", "py")
        found.append(best.join(whole, ["px", "py"], "left_semi"))
        open_places = open_places.join(whole, ["px", "py"], "left_anti").checkpoint()
        if open_places.isEmpty():
            break
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return points.select("point_id", "px", "py").join(every, ["px", "py"]).select("point_id", "way_id", "seg", "d2", "k")


def explicit_or_all(layers: DataFrame, eligible: list[str]) -> DataFrame:
    """Layers that feed one of the eligible info layers; where any of them is marked extended, only those that are."""
    own = layers.where(F.col("info_layer").isin(eligible)).withColumn("extended", F.coalesce("extended", F.lit(False)))
    marked = own.agg(F.coalesce(F.max("extended"), F.lit(False)).alias("any_extended"))
    return own.crossJoin(F.broadcast(marked)).where("extended OR NOT any_extended").drop("any_extended")


def bridged(outer: DataFrame, hole: DataFrame) -> DataFrame:
    """(feature_id, seq, x, y): open rings (feature_id, seq, x, y) with one hole each spliced in at the nearest pair of vertices.

    The outer ring runs up to its vertex, once around the hole from the hole's vertex and back to it, and goes on from
    the outer vertex; the ring is left open. Of equal pairs the first outer, then the first hole vertex counts.
    """
    pairs = outer.select("feature_id", F.col("seq").alias("i"), F.col("x").alias("ox"), F.col("y").alias("oy")).join(hole.select("feature_id", F.col("seq").alias("j"), F.col("x").alias("hx"), F.col("y").alias("hy")), "feature_id")
    dx, dy = F.col("ox") - F.col("hx"), F.col("oy") - F.col("hy")
    best = pairs.groupBy("feature_id").agg(F.min(F.struct((dx * dx + dy * dy).alias("d2"), "i", "j")).alias("m")).select("feature_id", "m.i", "m.j")
    sized = hole.groupBy("feature_id").agg(F.count("*").alias("n"))
    order = lambda part, k: F.struct(F.lit(part).alias("part"), F.col(k).alias("k"))
    around = hole.join(best, "feature_id").join(sized, "feature_id").withColumn("turn", F.pmod(F.col("seq") - F.col("j"), F.col("n")))
    around = around.withColumn("k", F.explode(F.when(F.col("turn") == 0, F.array(F.lit(0).cast("long"), F.col("n"))).otherwise(F.array("turn"))))
    ring = outer.join(best, "feature_id", "left")
    before = ring.where("i IS NULL OR seq <= i").select("feature_id", order(0, "seq").alias("o"), "x", "y")
    inside = around.select("feature_id", order(1, "k").alias("o"), "x", "y")
    after = ring.where("seq >= i").select("feature_id", order(2, "seq").alias("o"), "x", "y")
    rows = before.select("feature_id", F.col("o.part").alias("part"), F.col("o.k").cast("long").alias("k"), "x", "y")
    for more in (inside, after):
        rows = rows.unionByName(more.select("feature_id", F.col("o.part").alias("part"), F.col("o.k").cast("long").alias("k"), "x", "y"))
    return rows.select("feature_id", (F.row_number().over(Window.partitionBy("feature_id").orderBy("part", "k")) - 1).alias("seq"), "x", "y")
