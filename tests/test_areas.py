"""Components and area clean-up against plain set code on small grids."""

import random
from collections import defaultdict

import pytest

from cartolith.operators import areas as A
from cartolith.operators import cells as C
from cartolith.operators import graph
from cartolith.plans import registry


def flood(cells, diagonal=False):
    """Components of a set of (y, x), as sets."""
    left, found = set(cells), []
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0) and (diagonal or not dy or not dx)]
    while left:
        queue, own = [left.pop()], set()
        while queue:
            y, x = queue.pop()
            own.add((y, x))
            for dy, dx in steps:
                if (y + dy, x + dx) in left:
                    left.remove((y + dy, x + dx))
                    queue.append((y + dy, x + dx))
        found.append(own)
    return found


def box(n):
    return [(dy, dx) for dy in range(-n, n + 1) for dx in range(-n, n + 1)]


def grow(cells, n):
    return {(y + dy, x + dx) for y, x in cells for dy, dx in box(n)}


def shrink(cells, n):
    return {(y, x) for y, x in cells if all((y + dy, x + dx) in cells for dy, dx in box(n))}


def number(part):
    y, x = min(part)
    return y * graph.WIDE + x


def frame(spark, cells, keys=""):
    return spark.createDataFrame([(*k, y, x) for k, part in cells.items() for y, x in part], f"{keys}y long, x long")


def read(df, *keys):
    out = defaultdict(set)
    for r in df.collect():
        out[tuple(r[k] for k in keys)].add((r.y, r.x))
    return dict(out)


def noise(seed, n=40, share=0.55, at=(-7, -9)):
    rng = random.Random(seed)
    return {(y + at[0], x + at[1]) for y in range(n) for x in range(n) if rng.random() < share}


@pytest.mark.parametrize("diagonal", [False, True])
@pytest.mark.parametrize("tile", [8, 256])
def test_labels_equal_flood_fill(spark, diagonal, tile):
    spiral = {(y, x) for y in range(0, 40, 2) for x in range(40)} | {(y, 39 if y % 4 == 1 else 0) for y in range(1, 39, 2)}
    sets = {(1,): noise(1), (2,): noise(2, share=0.3), (3,): spiral, (4,): {(0, 0)}}
    found = read(graph.labelled(frame(spark, sets, "g long, "), ("g",), diagonal, tile), "g", "label")
    assert found == {(*k, number(part)): part for k, cells in sets.items() for part in flood(cells, diagonal)}


def test_labels_of_repeated_and_no_cells(spark):
    assert graph.labelled(spark.createDataFrame([], "y long, x long")).collect() == []
    assert [tuple(r) for r in graph.labelled(spark.createDataFrame([(1, 1), (1, 1)], "y int, x int")).collect()] == [(1, 1, graph.WIDE + 1)]


def test_components_of_keys(spark):
    chain = [(0, k, k + 1) for k in range(200)] + [(1, 5, 9), (1, 9, 7), (1, 3, 3), (1, 20, 30)]
    found = {(r.k, r.node): r.component for r in graph.components(spark.createDataFrame(chain, "k long, a long, b long"), ("k",)).collect()}
    assert found == {(0, k): 0 for k in range(201)} | {(1, 5): 5, (1, 7): 5, (1, 9): 5, (1, 20): 20, (1, 30): 20}


@pytest.mark.parametrize("n", [1, 2])
def test_grow_shrink_and_closing(spark, n):
    sets = {(1,): noise(3, 20, 0.4), (2,): noise(4, 20, 0.95)}
    rows = frame(spark, sets, "g long, ")
    assert read(A.grown(rows, n, ("g",)), "g") == {k: grow(c, n) for k, c in sets.items()}
    assert read(A.shrunk(rows, n, ("g",)), "g") == {k: shrink(c, n) for k, c in sets.items() if shrink(c, n)}
    closed = read(A.merged(rows, n, ("g",)), "g")
    assert closed == {k: shrink(grow(c, n), n) for k, c in sets.items()} and all(sets[k] <= closed[k] for k in sets)
    assert read(A.merged(rows, 0, ("g",)), "g") == sets


def test_distance_after_cut():
    assert A.distance_after_cut(6, 0) == 6 and A.distance_after_cut(6, 5) == 1.0 and A.distance_after_cut(6, 1) == 0.25 and A.distance_after_cut(0.1, 5) == 0.1


def brute_split(part, width):
    n, r = width // 2, width / 2
    seeds = [s for s in flood(shrink(part, n)) if len(s) > max(2 * r * r, 0.01 * len(part))]
    if len(seeds) < 2:
        return [part]
    claims = {}
    for s in sorted(seeds, key=lambda s: (len(s), -number(s))):
        claims |= dict.fromkeys(grow(s, n) & part, number(s))
    lobes = [lobe for s in seeds for lobe in flood({c for c, k in claims.items() if k == number(s)}) if len(lobe) > max(r * r, 0.005 * len(part))]
    return lobes if len(lobes) > 1 else [part]


def test_narrow_bridges_break(spark):
    rect = lambda y0, x0, h, w: {(y, x) for y in range(y0, y0 + h) for x in range(x0, x0 + w)}
    dumbbell = rect(0, 0, 12, 12) | rect(5, 12, 2, 6) | rect(0, 18, 12, 14) | rect(12, 20, 4, 2) | rect(16, 15, 12, 12)
    wide = rect(0, 0, 10, 30)
    speck = rect(0, 0, 12, 12) | rect(5, 12, 2, 4) | rect(4, 16, 3, 3)
    sets = {(1,): dumbbell, (2,): wide, (3,): speck}
    rows = frame(spark, sets, "g long, ").withColumnRenamed("y", "y")
    found = read(A.split_narrow(A.parts(rows, ("g",)), 4, ("g",)), "g", "part")
    want = {}
    for k, cells in sets.items():
        work = flood(cells)
        for _ in range(3):
            work = [new for part in work for new in brute_split(part, 4)]
        want |= {(*k, number(p)): p for p in work}
    assert found == want and len([k for k in found if k[0] == 1]) == 3 and len([k for k in found if k[0] == 2]) == 1


def test_inset_keeps_small_parts_and_cleaning_drops_slivers(spark):
    rect = lambda y0, x0, h, w: {(y, x) for y in range(y0, y0 + h) for x in range(x0, x0 + w)}
    cells = rect(0, 0, 10, 10) | rect(20, 0, 3, 3) | rect(40, 0, 2, 30)
    found = read(A.inset(A.parts(frame(spark, {(): cells})), 2), "part")
    assert sorted(map(len, found.values())) == [9, 36, 60]
    tidy = read(A.cleaned(A.parts(frame(spark, {(): cells | rect(10, 4, 6, 1)})), 9, 2), "part")
    assert sorted(map(len, tidy.values())) == [9, 100]


def test_flat_ribbons_cover_the_bands(spark):
    rng = random.Random(5)
    lines = {k: [(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(n)] for k, n in enumerate([2, 2, 3, 5, 2])} | {9: [(3, 3), (3, 3), (3, 20)], 10: [(0, 5), (20, 5)]}
    rows = spark.createDataFrame([(k, i, x, y) for k, pts in lines.items() for i, (x, y) in enumerate(pts)], "way_id long, seq long, x long, y long")
    found = read(A.flat_ribbons(rows, 3), "way_id")
    for k, pts in lines.items():
        want = set()
        for (ax, ay), (bx, by) in zip(pts, pts[1:], strict=False):
            dx, dy = bx - ax, by - ay
            far = dx * dx + dy * dy
            for y in range(-5, 50):
                for x in range(-5, 50):
                    if far and 0 <= dx * (x - ax) + dy * (y - ay) <= far and (dx * (y - ay) - dy * (x - ax)) ** 2 <= 9 * far:
                        want.add((y, x))
        for cx, cy in pts[1:-1]:
            want |= {(cy + dy, cx + dx) for dy, dx in box(3) if dx * dx + dy * dy <= 9}
        assert found[(k,)] == want, k


def test_component_ribbons_and_water(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 9, 0), (2, 0, 9, 0), (2, 1, 9, 9), (5, 0, 40, 40), (5, 1, 44, 40)], "way_id long, seq long, x long, y long")
    found = read(A.component_ribbons(rows, spark.createDataFrame([(1, 2)], "a long, b long"), 1), "component")
    assert set(found) == {(1,), (5,)} and found[(5,)] == {(y, x) for y in (39, 40, 41) for x in range(40, 45)}
    lake = spark.createDataFrame([(y, x) for y in range(20, 25) for x in range(20, 25)], "y long, x long")
    water = read(A.water_parts(rows, lake, 1), "part")
    assert sorted(map(len, water.values())) == [7 * 5, 81, len({(y, x) for y in range(-3, 4) for x in range(10)} | {(y, x) for y in range(10) for x in range(6, 13)})]


def test_whole_clean_up(spark):
    rect = lambda y0, x0, h, w: {(y, x) for y in range(y0, y0 + h) for x in range(x0, x0 + w)}
    own = {("a",): rect(0, 0, 20, 20) | rect(0, 21, 20, 20), ("b",): rect(10, 10, 20, 5)}
    targets = frame(spark, own, "group string, ")
    cuts = spark.createDataFrame([(y, 30) for y in range(20)], "y long, x long")
    holes = spark.createDataFrame([(y, x) for y in (4, 5) for x in (4, 5)], "y long, x long")
    found = A.cleaned_up(targets, cuts, holes, split_width=5, merge_distance=3, shrink=0, min_cells=10)
    got = read(found, "group", "part")
    gap = shrink(grow(own[("a",)] - {(y, 30) for y in range(20)}, 1), 1)
    want = flood(gap - {(4, 4), (4, 5), (5, 4), (5, 5)} - own[("b",)])
    assert {k for k in got if k[0] == "b"} == {("b", number(rect(20, 10, 10, 5)))}
    assert {k[1]: c for k, c in got.items() if k[0] == "a"} == {number(p): p for p in want if len(p) >= 10}
    stats = {r.group: tuple(r)[1:] for r in A.report(targets, found).collect()}
    assert stats["b"] == (100, 1, 50) and stats["a"][0] == 800


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_spans_give_sums_without_cells(spark):
    spans = spark.createDataFrame([("a", 0, 2, 5), ("a", 0, 2, 3), ("a", 0, 4, 9), ("a", 0, 5, 6), ("a", 0, 12, 12), ("a", 1, 0, 0), ("b", 0, 3, 4)], "k string, y long, low long, high long")
    found = C.pieces(spans, ("k",))
    want = [("a", y, x) for y, x in [*((0, x) for x in (*range(2, 10), 12)), (1, 0)]] + [("b", 0, 3), ("b", 0, 4)]
    assert sorted(map(tuple, C.run_cells(found).select("k", "y", "x").collect())) == sorted(want)
    few = C.run_cells(C.pieces(spans, ("k",), crowded=False)).select("k", "y", "x").collect()
    assert sorted(map(tuple, few)) == sorted(want)
    sums = {r.k: (r.cells, r.sx, r.sy) for r in C.span_sums(found, "k").collect()}
    assert sums == {k: (len(own), sum(x for _, _, x in own), sum(y for _, y, _ in own)) for k in "ab" for own in [[w for w in want if w[0] == k]]}


def test_ribbon_queries_make_no_cells(spark):
    for name in ("POLY_02_line_ribbon", "POLY_13_flat_ribbon", "POLY_15_component_ribbons"):
        # rows of segments and steps of discs are exploded, cells are not
        assert "sequence(low" not in plan(registry.queries()[name](spark, "/root/testdata/sf0.001")), name


def test_rectangles_of_one_size_are_eroded_once(spark):
    rects = [(1, 10, 10, 6, 8), (2, 40, 10, 6, 8), (3, 0, 10, 6, 8), (4, 13, 20, 6, 8), (5, 10, 10, 2, 2)]
    frame = spark.createDataFrame(rects, "feature_id long, x0 long, y0 long, w long, h long")
    cells = C.eroded(C.fill_rectangles(frame).select("feature_id", "x", "y"), 2, 20, 60, ("feature_id",)).groupBy("feature_id").count()
    want = dict(map(tuple, cells.collect()))
    found = {r.feature_id: (r.whole, r.cells) for r in C.eroded_sizes(frame, 2, 20, 60).collect()}
    assert found == {f: ((w + 1) * (h + 1), want.get(f, 0)) for f, _, _, w, h in rects}
