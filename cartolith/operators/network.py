"""Power networks, roads and placements: headings, snapping, linear referencing, deals, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartolith.operators import near


def headings(links: DataFrame, poles: DataFrame) -> DataFrame:
    """(pole, yaw): heading of each pole from the unit vectors to its neighbours, in the order of their ids.

    None: 0. Two that nearly oppose (dot < -0.85): the first one's angle less 90. Otherwise the angle of
    their sum, or of the first where the sum is zero.
    """
    at = lambda side: poles.select(F.col("pole").alias(side), F.col("x").alias(f"x{side}"), F.col("y").alias(f"y{side}"))
    v = links.select("a", "b").join(at("a"), "a").join(at("b"), "b").withColumn("dx", (F.col("xb") - F.col("xa")).cast("double")).withColumn("dy", (F.col("yb") - F.col("ya")).cast("double"))
    v = v.withColumn("n", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).where("n > 0").withColumn("ux", F.col("dx") / F.col("n")).withColumn("uy", F.col("dy") / F.col("n"))
    # a link is joined once and seen from both sides; numbers, not structs, are kept per pole, which needs no sort
    seen = lambda a, b, u: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), u("ux").alias("ux"), u("uy").alias("uy"))
    v = v.select(F.inline(F.array(seen("a", "b", F.col), seen("b", "a", lambda c: 0.0 - F.col(c)))))
    ends = [by(c, "b").alias(name + c) for by, name in ((F.min_by, "f"), (F.max_by, "l")) for c in ("ux", "uy")]
    g = v.groupBy("a").agg(F.count("*").alias("k"), *ends, F.round(F.sum("ux"), 9).alias("sx"), F.round(F.sum("uy"), 9).alias("sy"))
    dot = F.col("fux") * F.col("lux") + F.col("fuy") * F.col("luy")
    angle = lambda x, y: F.degrees(F.atan2(y, x))
    own = angle(F.col("fux"), F.col("fuy"))
    yaw = F.when((F.col("k") == 2) & (dot < -0.85), own - 90).when((F.col("sx") == 0) & (F.col("sy") == 0), own).otherwise(angle(F.col("sx"), F.col("sy")))
    found = g.select(F.col("a").alias("pole"), yaw.alias("yaw"), F.col("k"))
    return poles.select("pole").join(found, "pole", "left").select("pole", F.coalesce("yaw", F.lit(0.0)).alias("yaw"), F.coalesce("k", F.lit(0)).alias("degree"))


def quarter_turn_ends(yaws: DataFrame) -> DataFrame:
    """Chain ends (degree one) turn by 90 degrees."""
    return yaws.withColumn("yaw", F.when(F.col("degree") == 1, F.col("yaw") + 90).otherwise(F.col("yaw")))


def foot(px: Column, py: Column) -> tuple[Column, Column, Column]:
    """Parameter and place of the foot of a point on the segment (x1, y1)-(x2, y2)."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length2 = dx * dx + dy * dy
    t = F.when(length2 == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - F.col("x1")) * dx + (py - F.col("y1")) * dy) / length2)))
    return t, F.col("x1") + t * dx, F.col("y1") + t * dy


def snapped(hits: DataFrame, half_width: float, offset: float) -> DataFrame:
    """Points (px, py) with a nearest segment, moved to the road's edge on their own side."""
    _, fx, fy = foot(F.col("px"), F.col("py"))
    dx, dy = (F.col("x2") - F.col("x1")).cast("double"), (F.col("y2") - F.col("y1")).cast("double")
    n = F.sqrt(dx * dx + dy * dy)
    rows = hits.withColumn("fx", fx).withColumn("fy", fy).where(n > 0).withColumn("nx", -dy / n).withColumn("ny", dx / n)
    side = F.when((F.col("px") - F.col("fx")) * F.col("nx") + (F.col("py") - F.col("fy")) * F.col("ny") >= 0, 1.0).otherwise(-1.0)
    return rows.select("point_id", (F.col("fx") + F.col("nx") * side * (half_width + offset)).alias("x"), (F.col("fy") + F.col("ny") * side * (half_width + offset)).alias("y"))


def facing(hits: DataFrame, within: float) -> DataFrame:
    """Heading toward the nearest road's foot when it is within a distance, else 0."""
    _, fx, fy = foot(F.col("px"), F.col("py"))
    near = (F.col("d2") <= within * within) & (F.col("d2") > 0)
    return hits.select("point_id", F.when(near, F.degrees(F.atan2(fy - F.col("py"), fx - F.col("px")))).otherwise(0.0).alias("yaw"))


def referenced(hits: DataFrame, width: float, tile: float) -> DataFrame:
    """(point_id, u, v): lateral place across the ribbon in 0..1 and distance along it per tile."""
    t, _, _ = foot(F.col("px"), F.col("py"))
    dx, dy = (F.col("x2") - F.col("x1")).cast("double"), (F.col("y2") - F.col("y1")).cast("double")
    n = F.sqrt(dx * dx + dy * dy)
    lateral = (dx * (F.col("py") - F.col("y1")) - dy * (F.col("px") - F.col("x1"))) / n
    along = F.col("start") + t * n
    return hits.where(n > 0).select("point_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + lateral / width)).alias("u"), (along / tile).alias("v"))


def dealt(points: DataFrame, assets: int, *order: str) -> DataFrame:
    """Round robin by an integer hash of the place: even in expectation, without ranking all points in one task."""
    del order
    return points.withColumn("asset", (F.col("x") * 73856093 + F.col("y") * 19349663) % 2147483647 % assets)


def sampled_components(labelled: DataFrame, step: int) -> DataFrame:
    """(label, y, x, kind): per component the cell nearest its centroid, and every step-th cell of larger ones in row order."""
    centre = labelled.groupBy("label").agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.count("*").alias("n"))
    both = labelled.join(centre, "label")
    d2 = F.round((F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")) + (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")), 6)
    nearest = both.groupBy("label").agg(F.min(F.struct(d2.alias("d2"), "y", "x")).alias("m")).select("label", "m.y", "m.x", F.lit("centre").alias("kind"))
    order = Window.partitionBy("label").orderBy("y", "x")
    extra = both.where(F.col("n") > step).withColumn("k", F.row_number().over(order) - 1).where(F.col("k") % step == 0)
    extra = extra.select("label", "y", "x", F.lit("step").alias("kind")).join(nearest.select("label", "y", "x"), ["label", "y", "x"], "left_anti")
    return nearest.unionByName(extra)


def chosen(items: DataFrame, classes: DataFrame, seed: int) -> DataFrame:
    """(id, asset): a hash-chosen asset of the item's class; classes = small table (class, asset)."""
    ranked = classes.groupBy("class").agg(F.array_sort(F.collect_list("asset")).alias("assets"))
    pick = (F.col("id") * 73856093 + seed) % 2147483647 % F.size("assets")
    return items.join(F.broadcast(ranked), "class").select("id", F.get("assets", pick.cast("int")).alias("asset"))


def fallback_variant(rows: DataFrame, order: dict[str, int]) -> DataFrame:
    """The rows of the first variant, in priority order, that has any."""
    rank = F.coalesce(*[F.when(F.col("variant") == name, F.lit(k)) for name, k in order.items()])
    ranked = rows.withColumn("rank", rank)
    return ranked.crossJoin(F.broadcast(ranked.agg(F.min("rank").alias("least")))).where("rank = least").drop("rank", "least")


def clipped_lines(segments: DataFrame, size: int) -> DataFrame:
    """Segments (way_id, seg, x1, y1, x2, y2) clipped to the square 0..size; those outside go."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    low, high = F.lit(0.0), F.lit(1.0)
    for d, c in ((dx, F.col("x1")), (dy, F.col("y1"))):
        a, b = (0 - c) / d, (size - c) / d
        low = F.greatest(low, F.when(d != 0, F.least(a, b)).when((c < 0) | (c > size), 2.0).otherwise(0.0))
        high = F.least(high, F.when(d != 0, F.greatest(a, b)).otherwise(1.0))
    rows = segments.withColumn("t0", low).withColumn("t1", high).where("t0 <= t1")
    at = lambda c, d, t: (F.col(c) + F.col(t) * d)
    return rows.select("way_id", "seg", at("x1", dx, "t0").alias("ax"), at("y1", dy, "t0").alias("ay"), at("x1", dx, "t1").alias("bx"), at("y1", dy, "t1").alias("by"))


#: Buckets that the box of a line may touch, at most, so that the line is dealt to them whole.
WHOLE = 16


def connected_lines(segments: DataFrame, tolerance: float, bucket: int = 64, block: int = near.BLOCK) -> DataFrame:
    """(a, b), a < b: lines that meet, or of which one has an end within the tolerance of the other and points at it (cosine above 0.2).

    segments = (way_id, seg, x1, y1, x2, y2) of whole-number places. Lines are dealt to square buckets, so only
    neighbours are compared; those that touch more than WHOLE buckets by their segments.
    """
    box = [side(by(f"{c}1", f"{c}2")).alias(f"{name}_{c}") for c in "xy" for name, side, by in (("low", F.min, F.least), ("high", F.max, F.greatest))]
    lines = segments.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("seg", "x1", "y1", "x2", "y2"))).alias("s"), *box)
    lines = lines.select("way_id", *[F.col(f"s.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")], "low_x", "high_x", "low_y", "high_y").checkpoint()
    side = lambda c: F.floor((F.col(f"high_{c}") - F.col(f"low_{c}") + tolerance) / bucket) + 2
    short = side("x") * side("y") <= WHOLE
    found = near.connected(lines.where(short), tolerance, bucket, block)
    far = lines.where(~short).select("way_id")
    if far.isEmpty():
        return found
    marked = segments.join(far.withColumn("far", F.lit(True)), "way_id", "left").withColumn("far", F.coalesce("far", F.lit(False))).checkpoint()
    return found.unionByName(_connected_by_segment(marked, tolerance, bucket))


def _connected_by_segment(segments: DataFrame, tolerance: float, bucket: int) -> DataFrame:
    """The connected pairs with a line marked `far`; segments are dealt to buckets."""
    reach = int(-(-tolerance // 1))
    span = lambda a, b, by: F.sequence(F.floor((F.least(a, b) - by) / bucket), F.floor((F.greatest(a, b) + by) / bucket))
    dealt = lambda rows, by: rows.withColumn("bx", F.explode(span("x1", "x2", by))).withColumn("by", F.explode(span("y1", "y2", by)))
    far = segments.where("far")
    pairs = dealt(far, 0).alias("p").join(dealt(segments, 0).alias("q"), ["bx", "by"]).where("p.way_id < q.way_id OR (p.way_id > q.way_id AND NOT q.far)")
    side = lambda o, c, k: F.signum((F.col(f"{o}.x2") - F.col(f"{o}.x1")) * (F.col(f"{c}.y{k}") - F.col(f"{o}.y1")) - (F.col(f"{o}.y2") - F.col(f"{o}.y1")) * (F.col(f"{c}.x{k}") - F.col(f"{o}.x1")))
    boxes = [F.greatest(f"p.{c}1", f"p.{c}2") >= F.least(f"q.{c}1", f"q.{c}2") for c in "xy"] + [F.greatest(f"q.{c}1", f"q.{c}2") >= F.least(f"p.{c}1", f"p.{c}2") for c in "xy"]
    meets = (side("p", "q", 1) * side("p", "q", 2) <= 0) & (side("q", "p", 1) * side("q", "p", 2) <= 0)
    for inside in boxes:
        meets = meets & inside
    # a pair is judged in one of the buckets that it shares: that of the lower corner of the boxes' common part
    corner = [F.col(f"b{c}") == F.floor(F.greatest(F.least(f"p.{c}1", f"p.{c}2"), F.least(f"q.{c}1", f"q.{c}2")) / bucket) for c in "xy"]
    crossing = pairs.where(corner[0] & corner[1]).where(meets).select(F.least("p.way_id", "q.way_id").alias("a"), F.greatest("p.way_id", "q.way_id").alias("b"))
    bound = segments.groupBy("way_id", "far").agg(F.min_by(F.struct("x1", "y1", "x2", "y2"), "seg").alias("s"), F.max_by(F.struct("x1", "y1", "x2", "y2"), "seg").alias("e"))
    start = F.struct(F.lit(0).alias("end"), F.col("s.x1").alias("px"), F.col("s.y1").alias("py"), (F.col("s.x1") - F.col("s.x2")).alias("ux"), (F.col("s.y1") - F.col("s.y2")).alias("uy"))
    stop = F.struct(F.lit(1).alias("end"), F.col("e.x2").alias("px"), F.col("e.y2").alias("py"), (F.col("e.x2") - F.col("e.x1")).alias("ux"), (F.col("e.y2") - F.col("e.y1")).alias("uy"))
    ends = bound.select(F.col("way_id").alias("own"), "far", F.inline(F.array(start, stop))).withColumn("bx", F.floor(F.col("px") / bucket)).withColumn("by", F.floor(F.col("py") / bucket))
    _, fx, fy = foot(F.col("px"), F.col("py"))
    met = lambda some, others: some.drop("far").join(dealt(others.drop("far"), reach), ["bx", "by"]).where("own <> way_id")
    rows = met(ends.where("far"), segments).unionByName(met(ends.where("NOT far"), far)).withColumn("tx", fx - F.col("px")).withColumn("ty", fy - F.col("py"))
    rows = rows.withColumn("d2", F.round(F.col("tx") * F.col("tx") + F.col("ty") * F.col("ty"), 9)).where(F.col("d2") <= tolerance * tolerance)
    closest = rows.groupBy("own", "end", "way_id").agg(F.min_by(F.struct("d2", "tx", "ty", "ux", "uy"), F.struct("d2", "seg")).alias("m")).select("own", "way_id", "m.*")
    length = F.sqrt((F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy")).cast("double")) * F.sqrt("d2")
    aimed = closest.where((F.col("d2") == 0) | ((length > 0) & (F.col("ux") * F.col("tx") + F.col("uy") * F.col("ty") > 0.2 * length)))
    return crossing.unionByName(aimed.select(F.least("own", "way_id").alias("a"), F.greatest("own", "way_id").alias("b"))).distinct()


def connector_places(poles: DataFrame) -> DataFrame:
    """(pole, no, cx, cy, cz): world places of connectors; poles = (pole, x, y, z, yaw, connectors of side and height), y up.

    The side runs along the pole's right axis (-sin yaw, cos yaw).
    """
    rows = poles.select("pole", "x", "y", "z", F.radians("yaw").alias("yaw"), F.posexplode("connectors").alias("no", "c"))
    return rows.select("pole", "no", (F.col("x") - F.col("c.side") * F.sin("yaw")).alias("cx"), (F.col("y") + F.col("c.height")).alias("cy"), (F.col("z") + F.col("c.side") * F.cos("yaw")).alias("cz"))


def gathered(places: DataFrame) -> DataFrame:
    """(pole, places): the connectors (no, cx, cy, cz) of every pole in one row, so that links need no join for each of them."""
    return places.groupBy("pole").agg(F.collect_list(F.struct("no", "cx", "cy", "cz")).alias("places"))


def paired_connectors(links: DataFrame, poles: DataFrame) -> DataFrame:
    """(a, b, k, x1, y1, z1, x2, y2, z2): wires of linked poles without crossings.

    The connectors of either side are ranked along the right axis of the pair and joined by rank, or, when that is
    shorter in all, with the ranks of b reversed. A pair has as many wires as its smaller side; poles on one place have none.
    """
    own = poles.select("pole", "x", "z").join(gathered(connector_places(poles)), "pole")
    at = lambda side: own.select(F.col("pole").alias(side), F.col("x").alias(f"{side}x"), F.col("z").alias(f"{side}z"), F.col("places").alias(f"{side}p"))
    dx, dz = (F.col(f"b{c}").cast("double") - F.col(f"a{c}") for c in "xz")
    length = F.sqrt(dx * dx + dz * dz)
    pairs = links.select("a", "b").join(at("a"), "a").join(at("b"), "b").where(length > 0).withColumn("rx", -dz / length).withColumn("rz", dx / length)

    def ranked(side: str) -> Column:
        along = lambda c: F.round(c["cx"] * F.col("rx") + c["cz"] * F.col("rz"), 9)
        return F.array_sort(F.transform(f"{side}p", lambda c: F.struct(along(c).alias("along"), c["no"].alias("no"), c["cx"].alias("x"), c["cy"].alias("y"), c["cz"].alias("z"))))

    wires = F.least(F.size("left"), F.size("right"))
    joined = lambda right: F.zip_with(F.slice("left", F.lit(1), wires), F.slice(right, F.lit(1), wires), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    apart = lambda w: F.sqrt(sum((w["p"][c] - w["q"][c]) * (w["p"][c] - w["q"][c]) for c in "xyz"))
    cost = lambda pairs: F.round(F.aggregate(pairs, F.lit(0.0), lambda total, w: total + apart(w)), 9)
    rows = pairs.select("a", "b", ranked("a").alias("left"), ranked("b").alias("right"))
    rows = rows.select("a", "b", joined("right").alias("plain"), joined(F.reverse("right")).alias("turned"))
    chosen_wires = rows.select("a", "b", F.posexplode(F.when(cost("plain") > cost("turned"), F.col("turned")).otherwise(F.col("plain"))).alias("no", "w"))
    return chosen_wires.select("a", "b", (F.col("no") + 1).alias("k"), *[F.col(f"w.{p}.{c}").alias(f"{c}{n}") for p, n in (("p", 1), ("q", 2)) for c in "xyz"])
