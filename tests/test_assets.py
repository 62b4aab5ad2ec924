"""Asset files, sizes and islands on small data."""

import math

from cartolith.operators import assets as X
from cartolith.operators import cover as V

NODES = "file string, root_name string, tag string, name string, translation string, clip_distance string, lod_distance string, hidden string"


def test_files(spark, tmp_path):
    for name in ("a/one.abc", "a/two.ABC", "a/two.txt", "b/x_placeholder.abc", "b/.abc2", "b/deep/three.abc", "top.abc"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    found = {(r.folder, r.name): r.length for r in X.files(spark, f"file://{tmp_path}", (".abc",), ("placeholder",)).collect()}
    assert found == {("a", "one.abc"): 9, ("a", "two.ABC"): 9}


def test_sizes_by_the_first_way(spark):
    node = lambda file, tag, name="", at=None, clip=None, lod=None, hidden=None, root=None: (file, root, tag, name, at, clip, lod, hidden)
    rows = [
        node("lights", "Light", at="0 1 0"), node("lights", "Light", at="10 3 20"), node("lights", "Shape", at="90 0 0"),
        node("far lights", "Light", at="0 0 0"), node("far lights", "Light", at="300 0 10"), node("far lights", "Shape", clip="80"),
        node("shapes", "Shape", "wall", "1 2 3"), node("shapes", "Shape", "wall", "5 4 9"), node("shapes", "Shape", "roof", "3 8 4"), node("shapes", "Shape", "decal", "99 0 0"), node("shapes", "Shape", "x", "0 0 0"),
        node("hints", "Shape", "a", "bad", "150", "0 300 20", root="oldFireStation"), node("hints", "Node", "b", clip="x"),
        node("count", "Shape", "window1", root="garage02"), node("count", "Shape", "door"), node("count", "Shape", "colWindow", hidden="true"), node("count", "Shape", "wall"),
        node("none", "Node", "x", lod="5"),
    ]
    found = {r.file: tuple(r)[1:] for r in X.sizes(spark.createDataFrame(rows, NODES)).collect()}
    assert found["lights"] == (12.0, 22.0, 5.0, 264.0, "light_analysis")
    assert found["far lights"] == (11.0, 8.4, 4.0, 92.4, "distance_hints")
    assert found["shapes"] == (5.0, 7.0, 7.0, 35.0, "shape_envelope")
    assert found["hints"] == (29.0, 23.0, 6.0, 667.0, "distance_hints")
    assert found["count"] == (11.1, 7.7, 3.5, round((8.4 * 1.2 + 1) * (6.32 * 1.1 + 0.7), 1), "shape_analysis")
    assert found["none"] == (None,) * 5


def test_islands(spark):
    n, width, height, rounding = 12, 90, 70, 3
    outline = {}
    for r in V.corners(spark.range(n).withColumnRenamed("id", "island"), width, height, 5, 8, 30).orderBy("seq").collect():
        outline.setdefault((r.island, r.code), []).append((r.x, r.y))
    assert len(outline) == n and all(len(p) == 31 and p[0] == p[-1] for p in outline.values()) and {c for _, c in outline} <= set(V.CODES)
    want = {}
    for (_, code), pts in sorted(outline.items()):
        xs, ys = [p[0] for p in pts], [p[1] for p in pts]
        for y in range(max(0, min(ys) - 3), min(height, max(ys) + 4)):
            for x in range(max(0, min(xs) - 3), min(width, max(xs) + 4)):
                near, odd = False, 0
                cross = []
                for (ax, ay), (bx, by) in zip(pts, pts[1:], strict=False):
                    l2 = (bx - ax) ** 2 + (by - ay) ** 2
                    t = max(0, min(1, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / l2)) if l2 else 0
                    near = near or (x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by - ay)) ** 2 <= rounding**2 + 1e-9
                    if (ay <= y) != (by <= y):
                        cross.append(ax + (y - ay) * (bx - ax) / (by - ay))
                cross.sort()
                odd = any(math.ceil(a) <= x <= math.floor(b) for a, b in zip(cross[::2], cross[1::2], strict=False))
                if near or odd:
                    want[(y, x)] = code
    found = {(r.y, r.x): r.code for r in V.islands(spark.range(n).withColumnRenamed("id", "island"), width, height, 5, rounding, 8, 30).collect()}
    assert found == want
