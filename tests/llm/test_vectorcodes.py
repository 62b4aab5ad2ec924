"""Vector codes against brute force in Python numbers."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from cartolith.llm import vectorcodes

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, code string"


def brute(rows, parts=4, entries=256, rounds=4):
    """(vec_id, code numbers, error, label) of the kept rows in the given order, and the codebooks."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = max(1, -(-max(len(r[1]) for r in rows) // parts))
    cut = lambda v: [[math.floor(1024 * v[k]) if k < len(v) else 0 for k in range(p * width, (p + 1) * width)] for p in range(parts)]
    own = [cut(r[1]) for r in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, list(rows[k][1])))[:entries]
    books = [[own[k][p] for k in order] for p in range(parts)]
    best = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for v in own:
                groups[best(v[p], books[p])[1]].append(v[p])
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(books[p])]
    found = [[best(v[p], books[p]) for p in range(parts)] for v in own]
    return [(r[0], tuple(k for _, k in f), sum(d for d, _ in f), r[2]) for r, f in zip(rows, found, strict=True)], books


@pytest.mark.parametrize("width", [1, 2, 3, 5, 16])
def test_nearest_equals_all_distances(width):
    rng = np.random.default_rng(width)
    for scale in (1, 3, 900):
        rows, entries = rng.integers(-scale, scale + 1, (600, width)), rng.integers(-scale, scale + 1, (70, width))
        want = ((rows[:, None] - entries[None]) ** 2).sum(axis=2)
        codes, errors = vectorcodes.nearest(vectorcodes.transformed(rows), vectorcodes.transformed(entries))
        assert (codes == want.argmin(axis=1)).all() and (errors == want.min(axis=1)).all()
        codes, errors = vectorcodes.nearest(vectorcodes.transformed(rows.astype(object) << 90), vectorcodes.transformed(entries.astype(object) << 90))
        assert (codes == want.argmin(axis=1)).all() and (errors >> 180 == want.min(axis=1)).all()


def test_coefficients_rise_in_sign_changes():
    for size in (1, 2, 8, 32):
        waves = vectorcodes.transformed(np.eye(size, dtype=np.int64)).T
        assert [(np.diff(w) != 0).sum() for w in waves] == list(range(size))


def coded(spark, rows, **options):
    kept = vectorcodes.kept(spark.createDataFrame(rows, SCHEMA))
    books, dims = vectorcodes.trained(kept, **options)
    return vectorcodes.with_label_error(vectorcodes.coded(kept, books, dims)).collect(), books


@pytest.mark.parametrize("entries", [4, 256])
def test_edges(spark, entries):
    rng = np.random.default_rng(5)
    vectors = [[float(x) for x in rng.normal(0, 0.3, n)] for n in (6, 6, 5, 0, 6, 3, 6, 6)]
    rows = [(k, v, k % 3, "x") for k, v in enumerate(vectors)]
    rows += [(3, vectors[0], None, None), (3, vectors[0], None, "y"), (None, vectors[1], 1, "z"), (20, None, 1, ""), (21, [0.1, None], 1, ""), (22, [0.1, math.nan], 1, ""), (23, [math.inf], 1, ""), (24, [-math.inf], 0, "")]
    found, books = coded(spark, rows, entries=entries)
    want, entries_of = brute(rows, entries=entries)
    assert books.sha256() == hashlib.sha256(",".join(str(v) for b in entries_of for e in b for v in e).encode()).hexdigest()
    total = defaultdict(int)
    for _, _, error, label in want:
        total[label] += error
    assert sorted(map(str, want)) == sorted(str((r.vec_id, tuple(r.codes), r.error, r.label)) for r in found)
    assert all(r.label_error == total[r.label] for r in found)


def test_numbers_beyond_64_bits(spark):
    """Exact where squares fit in no long; an error that no long holds is null."""
    rows = [(k, [(k % 5) * 1e300 + k, 1e9 * k, 0.5 * k, -1e-3 * k], k % 2, "") for k in range(40)]
    found, books = coded(spark, rows, entries=6)
    want, entries_of = brute(rows, entries=6)
    assert [b.tolist() for b in books.books] == entries_of
    assert sorted((v, c) for v, c, _, _ in want) == sorted((r.vec_id, tuple(r.codes)) for r in found)
    top = vectorcodes.LONG
    assert {v: e if e <= top else None for v, _, e, _ in want} == {r.vec_id: r.error for r in found}


def test_empty_table(spark):
    assert coded(spark, []) == ([], None)


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding], r.label) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").where("vec_id < 120").collect()]
    want, _ = brute(rows, entries=30, rounds=2)
    found, _ = coded(spark, [(*r, "") for r in rows], entries=30, rounds=2)
    assert sorted((v, c, e) for v, c, e, _ in want) == sorted((r.vec_id, tuple(r.codes), r.error) for r in found)


def test_query_equals_sql(spark):
    import duckdb

    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    found = vectorcodes.op13_vector_codes(spark, DATA)
    want = duck.sql(vectorcodes.SQL["op13_vector_codes"])
    assert want.columns == found.columns and sorted(map(tuple, found.collect())) == sorted(want.fetchall())
