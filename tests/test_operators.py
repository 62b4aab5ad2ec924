"""Operators on hand-made frames."""

import random

import pytest
from pyspark.sql import functions as F

from cartolith.operators import cells as C
from cartolith.operators import cells, features, lines, raster, tags, terrain
from cartolith.plans import registry
from cartolith.session import UNASKED, bound_broadcasts
from cartolith.sources import catalogues


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def test_rule_semantics(spark):
    df = spark.createDataFrame([(1, {"a": "x", "f": "no"}), (2, {"a": ""}), (3, {})], "id long, t map<string,string>")
    hit = lambda rule: [r[0] for r in df.where(tags.matches(F.col("t"), rule)).orderBy("id").collect()]
    assert hit({"a": True}) == [1]
    assert hit({"f": False}) == [1]
    assert hit({"a": ["x", "y"]}) == [1]
    assert hit({"a": "x", "missing": True}) == []
    with pytest.raises(ValueError):
        tags.first_match(F.col("t"), [{}])


def test_erosion_undoes_dilation_of_a_rectangle(spark):
    own = spark.createDataFrame([(x, y) for x in range(3, 8) for y in range(2, 6)], "x long, y long")
    assert rows(cells.eroded(cells.dilated(own, 1, 20, 20), 1, 20, 20)) == rows(own)


def test_components_equal_flood_fill(spark):
    own = {(0, 0), (1, 1), (5, 5), (5, 6), (9, 0)}
    found = raster.components(spark.createDataFrame(sorted(own), "y long, x long")).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.label, set()).add((r.y, r.x))
    assert sorted(map(sorted, groups.values())) == [[(0, 0), (1, 1)], [(5, 5), (5, 6)], [(9, 0)]]


def test_dense_ids_are_gapless_and_ordered(spark):
    df = features.dense_ids(spark.range(1000).withColumn("k", F.col("id") * 7 % 1000), ["k"], 5)
    found = [(r.k, r.new_id) for r in df.orderBy("k").collect()]
    assert [n for _, n in found] == list(range(5, 1005))


def test_stations_keep_both_ends(spark):
    line = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 10, 0), (1, 2, 10, 5)], "way_id long, seq long, x long, y long")
    found = lines.stations(line, 4.0).orderBy("station").collect()
    assert (found[0].x, found[0].y) == (0, 0) and (round(found[-1].x, 6), round(found[-1].y, 6)) == (10, 5)
    assert len(found) == 5


def test_closure_survives_cycles(spark):
    members = spark.createDataFrame([(1, "relation", 2), (2, "relation", 1), (2, "way", 7)], "rel_id long, type string, ref long")
    roots = spark.createDataFrame([(1,)], "rel_id long")
    closed = features.closure(members, roots)
    assert rows(closed) == [(1, 1), (1, 2)]
    assert rows(features.reached_ways(members, closed)) == [(1, 7)]


def test_closure_goes_to_any_depth(spark):
    members = spark.createDataFrame([(k, "relation", k + 1) for k in range(1, 13)] + [(13, "way", 7)], "rel_id long, type string, ref long")
    closed = features.closure(members, spark.createDataFrame([(1,)], "rel_id long"))
    assert rows(features.reached_ways(members, closed)) == [(1, 7)]


def test_all_zero_grid_is_an_error(spark):
    with pytest.raises(Exception, match="all cells are zero"):
        raster.checked(spark.createDataFrame([(0, 0, 0)], "y long, x long, v long")).collect()


def test_line_components_equal_union_find(spark, monkeypatch):
    from cartolith.plans import network_queries

    own = [(1, 0, 10), (1, 1, 11), (2, 0, 11), (3, 0, 12), (4, 0, 13), (4, 1, 12), (5, 0, 99)]
    frame = spark.createDataFrame(own, "way_id long, seq long, node_id long")
    build = network_queries.POLY_16
    found = dict(map(tuple, build(lambda name: frame).collect()))
    assert found == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_catalogue_list_over_many_lines_and_bad_entries(spark, tmp_path):
    path = tmp_path / "assets.json"
    path.write_text('[\n {"file": "a", "name": "x", "connectors": [{"side": 1}, {"side": "left"}, null]},\n {"file": "b", "name": "y"},\n {"name": "z"}\n]')
    found = {r.file: [(c.side, c.height) for c in r.connectors] for r in catalogues.assets(spark, str(path), multi_line=True).collect()}
    assert found == {"a": [(1.0, 10.0)], "b": [(-2.0, 10.0), (2.0, 10.0)]}


def test_edge_distance_without_an_edge_is_null(spark):
    full = spark.createDataFrame([(y, x, True) for y in range(3) for x in range(4)], "y long, x long, inside boolean")
    assert {r.d2 for r in terrain.edge_distance(full).collect()} == {None}


def test_ribbon_spans_equal_distances(spark):
    rng = random.Random(5)
    ends = [(k, [rng.randrange(-20, 20) for _ in range(4)]) for k in range(120)] + [(120, [3, 3, 3, 3]), (121, [0, 5, 9, 5]), (122, [5, 0, 5, 9])]
    points = spark.createDataFrame([(k, i, p[2 * i], p[2 * i + 1]) for k, p in ends for i in (0, 1)], "way_id long, seq long, x long, y long")
    got = {(r.way_id, r.x, r.y) for r in cells.ribbons(points, 3).collect()}

    def near(p, x, y):
        dx, dy = p[2] - p[0], p[3] - p[1]
        t = max(0.0, min(1.0, ((x - p[0]) * dx + (y - p[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
        return (x - p[0] - t * dx) ** 2 + (y - p[1] - t * dy) ** 2 <= 9 + 1e-9

    assert got == {(k, x, y) for k, p in ends for x in range(-24, 24) for y in range(-24, 24) if near(p, x, y)}


def test_large_tables_are_not_broadcast_unasked(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    try:
        for given, left in (("10MB", UNASKED), ("10485760b", UNASKED), ("100k", "100k"), ("-1", "-1"), ("4096", "4096")):
            spark.conf.set(name, given)
            bound_broadcasts(spark)
            assert spark.conf.get(name).rstrip("b") in (str(left), str(int(str(left).replace("k", "")) << 10))
    finally:
        spark.conf.set(name, before)


def test_components_need_few_rounds(spark):
    """A long snake over tiles is labelled tile by tile; labels are y * 2^20 + x of the first cell."""
    snake = [(y, x) for y in range(0, 40, 2) for x in range(1100)] + [(y, 1099 if y % 4 == 1 else 0) for y in range(1, 39, 2)]
    made = spark.createDataFrame([(y + 3, x + 5) for y, x in snake], "y long, x long")
    before = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    found = raster.components(made)
    assert {r.label for r in found.select("label").distinct().collect()} == {3 * (1 << 20) + 5}
    assert found.count() == len(snake)
    assert spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs() - before < 150


def test_runs_equal_sets_of_cells(spark):
    draw = random.Random(5)
    span = lambda: (draw.randrange(3), draw.randrange(4), low := draw.randrange(-9, 40), low + draw.randrange(9))
    some, less = [span() for _ in range(80)], [span() for _ in range(20)]
    made = lambda rows_: spark.createDataFrame(rows_, "k long, y long, low long, high long")
    cover = lambda rows_: {(k, y, x) for k, y, low, high in rows_ for x in range(low, high + 1)}
    found = cells.run_cells(cells.runs(made(some), ("k",), made(less))).select("k", "y", "x").collect()
    assert sorted(map(tuple, found)) == sorted(cover(some) - cover(less))
    assert rows(cells.run_cells(cells.runs(made(some), ("k",))).select("k", "y", "x")) == sorted(cover(some))


def test_runs_take_equal_spans_as_one(spark):
    many = spark.range(2000).selectExpr("id % 3 AS y", "0L AS low", "99999999L AS high")
    assert rows(cells.runs(many).select("y", "low", "high")) == [(y, 0, 99999999) for y in range(3)]


def test_cells_left_equal_cells(spark):
    draw = random.Random(7)
    rects = [(i, draw.randrange(90), draw.randrange(90), draw.randrange(70), draw.randrange(5)) for i in range(60)]
    rects += [(100 + i, *r[1:]) for i, r in enumerate(rects)]
    taken = [(y, low, low + draw.randrange(40)) for y in range(100) for low in (draw.randrange(-20, 60), draw.randrange(110, 150))]
    gone = {(y, x) for y, low, high in taken for x in range(low, high + 1)}
    found = cells.cells_left(spark.createDataFrame(rects, "feature_id long, x0 long, y0 long, w long, h long"), spark.createDataFrame(taken, "y long, low long, high long"))
    want = {i: sum((y, x) not in gone for y in range(y0, y0 + h + 1) for x in range(x0, x0 + w + 1)) for i, x0, y0, w, h in rects}
    assert dict(map(tuple, found.select("feature_id", "cells").collect())) == {i: n for i, n in want.items() if n}


def test_equal_sizes_are_matched_once(spark):
    """Pairs would be 2.5 billion."""
    wanted = spark.range(50000).selectExpr("id AS footprint_id", "'a' AS category", "10L AS width", "8L AS depth")
    entries = spark.range(50000).selectExpr("id + 7 AS ord", "'a' AS category", "8L AS width", "10L AS depth")
    found = features.best_match(wanted, entries, 0.3)
    assert found.groupBy("ord", "score", "turned").count().collect() == [(7, 180.0, True, 50000)]


def test_equal_places_are_compared_once(spark):
    """Pairs would be billions; the smallest id counts on equal places."""
    left = spark.range(100000).selectExpr("id AS left_id", "id % 2 * 5 AS x", "0L AS y")
    right = spark.range(100000).selectExpr("id + 3 AS right_id", "id % 2 * 4 AS x", "1L AS y")
    found = features.nearest_within(left, right, 10, 10).groupBy("right_id", "d2").count()
    assert rows(found) == [(3, 1, 50000), (4, 2, 50000)]
    segs = spark.range(2000).selectExpr("id AS way_id", "0 AS seg", "0L AS x1", "id AS y1", "50L AS x2", "id AS y2")
    points = spark.range(200000).selectExpr("id AS point_id", "id % 2 * 10 AS px", "id % 2 * 1000 + 1 AS py")
    near = features.nearest_segments(points, segs, 100, 256, 2)
    assert rows(near.groupBy("way_id", "d2", "k").count()) == [(0, 1.0, 2, 100000), (1, 0.0, 1, 100000), (1000, 1.0, 2, 100000), (1001, 0.0, 1, 100000)]


def test_nearest_segments_equal_all_pairs(spark):
    draw = random.Random(3)
    segs = [(w, s, *(draw.randrange(1500) for _ in range(2))) for w in range(40) for s in range(2)]
    segs = [(w, s, x, y, x + draw.randrange(-30, 31), y + draw.randrange(-30, 31)) for w, s, x, y in segs]
    points = [(i, draw.randrange(1500), draw.randrange(1500)) for i in range(120)]

    def d2(px, py, x1, y1, x2, y2):
        dx, dy = x2 - x1, y2 - y1
        t = max(0, min(1, ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
        return round((px - x1 - t * dx) ** 2 + (py - y1 - t * dy) ** 2, 6)

    want = []
    for i, px, py in points:
        near = sorted((d, w, s) for w, s, *at in segs if (d := d2(px, py, *at)) <= 10000)[:3]
        want += [(i, w, s, k + 1) for k, (_, w, s) in enumerate(near)]
    frame = spark.createDataFrame(segs, "way_id long, seg long, x1 long, y1 long, x2 long, y2 long")
    found = features.nearest_segments(spark.createDataFrame(points, "point_id long, px long, py long"), frame, 100, 256, 3)
    assert rows(found.select("point_id", "way_id", "seg", "k")) == sorted(want)


def test_tasks_after_a_shuffle_grow_with_the_tables(spark, tmp_path, monkeypatch):
    from cartolith import session

    (tmp_path / "part.parquet").write_bytes(bytes(1000))
    names = ["spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    before = [spark.conf.get(n, None) for n in names]
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    session.bound_tasks(spark, str(tmp_path))
    assert int(spark.conf.get(names[0])) == own
    monkeypatch.setattr(session, "SHARE", 10)
    session.bound_tasks(spark, str(tmp_path))
    assert int(spark.conf.get(names[0])) == max(own, 100) and int(spark.conf.get(names[1])) == session.READ
    for name, value in zip(names, before, strict=True):
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_least_rectangles_take_one_shuffle(spark):
    from cartolith.plans import registry

    text = registry.queries()["AGG_20_min_area_rectangle"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and text.count("Exchange") == 1


def test_largest_claim_of_rectangles_by_blocks(spark):
    draw = random.Random(5)
    rects = [(k, "ab"[k % 2], draw.randrange(-9, 20), draw.randrange(-9, 20), draw.randrange(0, 12), draw.randrange(0, 40 if k == 3 else 9)) for k in range(-20, 40)]
    rects += [(100 + k, *rects[4][1:]) for k in range(50)]
    claims = spark.createDataFrame(rects, "id long, kind string, x0 long, y0 long, w long, h long")
    claims = claims.withColumn("claim", C.ranked((F.col("w") + 1) * (F.col("h") + 1), F.col("id")))
    for keys in ((), ("kind",)):
        want = {}
        for k, kind, x0, y0, w, h in rects:
            for y in range(y0, y0 + h + 1):
                for x in range(x0, x0 + w + 1):
                    at = ((kind,) if keys else ()) + (y, x)
                    want[at] = max(want.get(at, (0, 0)), ((w + 1) * (h + 1), -k))
        found = C.over_rectangles(claims, "claim", keys).select(*keys, "y", "x", C.ranked_id(F.col("claim"))).collect()
        assert {tuple(r)[:-1]: -r[-1] for r in found} == {at: m for at, (_, m) in want.items()} and len(found) == len(want)
    assert C.over_rectangles(claims.where("id > 1000"), "claim").collect() == []


@pytest.mark.parametrize("name", ["WIN_14_first_claim", "WIN_15_disjoint_surface", "JOIN_09_cross_group_holes"])
def test_overlays_shuffle_no_cells_of_single_claims(spark, name):
    """What cells are made of grows with the frame, not with all claims, and no shuffle files are left."""
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan and "parquet" not in plan.lower()  # claims are reduced to blocks and stretches before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
