"""Rotated grids and fitted objects against plain code."""

import math
import random

import numpy as np
import pytest

from cartolith.operators import fitting as T


@pytest.mark.parametrize("angle", [0, 90, 30, -75])
def test_rotated_grid(spark, angle):
    grid = np.random.default_rng(1).integers(0, 100, (21, 17)).astype(float)
    cells = spark.createDataFrame([(y, x, float(grid[y, x])) for y in range(21) for x in range(17)], "y long, x long, v double")
    found = {(r.y, r.x): r.v for r in T.rotated_grid(cells, angle, 17, 21, 13, 15).collect()}
    a, at = math.radians(angle), lambda y, x: grid[y, x] if 0 <= y < 21 and 0 <= x < 17 else 0.0
    for ty in range(15):
        for tx in range(13):
            dx, dy = tx - 6, ty - 7
            sx, sy = round(math.cos(a) * dx - math.sin(a) * dy + 8, 9), round(math.sin(a) * dx + math.cos(a) * dy + 10, 9)
            x, y = math.floor(sx), math.floor(sy)
            fx, fy = sx - x, sy - y
            want = (at(y, x) * (1 - fx) + at(y, x + 1) * fx) * (1 - fy) + (at(y + 1, x) * (1 - fx) + at(y + 1, x + 1) * fx) * fy
            assert abs(found[(ty, tx)] - want) < 1e-9
    assert len(found) == 195


def test_fitted_lines(spark):
    lines = {1: [(1, 1), (5, 5), (9, 1)], 2: [(-5, 5), (5, 5), (15, 5)], 3: [(5, 5), (15, 5), (15, 8), (5, 8)], 4: [(20, 20), (30, 30)], 5: [(4, 4), (4, 4)], 6: [(-5, 5), (5, 15)], 7: [(2, 2), (2, 2), (2, 12)], 8: [(-2, 0), (12, 0)]}
    rows = spark.createDataFrame([(k, i, x, y) for k, pts in lines.items() for i, (x, y) in enumerate(pts)], "way_id long, seq long, x long, y long")
    found, rejected = T.fitted_lines(rows, 0, 10)
    got = {}
    for r in sorted(found.collect(), key=lambda r: r.seq):
        got.setdefault(r.way_id, []).append((r.x, r.y))
    assert got == {1: [(1, 1), (5, 5), (9, 1)], 2: [(0, 5), (5, 5), (10, 5)], 7: [(2, 2), (2, 10)], 8: [(0, 0), (10, 0)]}
    assert {r.way_id: r.parts for r in rejected.collect()} == {3: 2, 4: 0, 5: 0, 6: 0}
    found, _ = T.fitted_lines(spark.createDataFrame([(1, 0, 5, 5), (1, 1, 5, 9)], "way_id long, seq long, x long, y long"), 0, 100, 90, (5, 5), (10, 20))
    assert [(round(r.x, 6), round(r.y, 6)) for r in found.orderBy("seq").collect()] == [(15, 25), (19, 25)]


def test_fitted_areas(spark):
    rng = random.Random(4)
    rings = {}
    for k in range(40):
        x, y, w, h, a = rng.uniform(-6, 14), rng.uniform(-6, 14), rng.uniform(1, 8), rng.uniform(1, 8), rng.uniform(0, 3)
        pts = [(x + math.cos(a) * i - math.sin(a) * j, y + math.sin(a) * i + math.cos(a) * j) for i, j in ((0, 0), (w, 0), (w, h), (0, h))]
        rings[k] = [*pts, pts[0]]
    rows = spark.createDataFrame([(k, i, x, y) for k, pts in rings.items() for i, (x, y) in enumerate(pts)], "feature_id long, seq long, x double, y double")
    got = {}
    for r in sorted(T.fitted_areas(rows, 0, 10).collect(), key=lambda r: r.seq):
        got.setdefault(r.feature_id, []).append((r.x, r.y))
    area = lambda p: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:], strict=False))) / 2
    n = 100
    grid = [(i + 0.5) * 10 / n for i in range(n)]
    for k, pts in rings.items():
        inside = sum(all((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= 0 for a, b in zip(pts, pts[1:], strict=False)) for x in grid for y in grid) * (10 / n) ** 2
        assert abs(area(got.get(k, [])) - inside) < 0.8 and all(-1e-9 <= c <= 10 + 1e-9 for p in got.get(k, []) for c in p)
        assert k not in got or got[k][0] == got[k][-1]
    assert 10 < len(got) < 40
