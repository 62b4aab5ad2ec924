"""Periodic runs against brute force."""

import hashlib
import random
import time
import zlib

import numpy as np

from cartolith.llm import periods

DATA = "/root/testdata/sf0.001"


def brute(words, least):
    """Every stretch of equal words p apart, for every p; of one stretch the smallest p."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(2 * p, least):
                found.setdefault((i, j + p), p)
            i = j
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force_in_portions_of_any_size():
    rng, total = random.Random(7), 0
    for _ in range(1500):
        n, kinds = rng.choice([5, 12, 13, 30, 60, 150]), rng.choice([1, 2, 3, 5])
        words = [rng.randrange(kinds) for _ in range(n)]
        if rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randint(1, 12)
            words = words[:a] + [words[min(a + (i - a) % p, n - 1)] for i in range(a, n)]
        least = rng.choice([2, 5, 12, 20])
        want = brute(words, least)
        total += len(want)
        for portion in (1, 7, rng.randint(2, n), 1 << 15):
            assert periods.runs_of(np.array(words), least, portion) == want, (words, least, portion)
    assert total > 3000


def test_long_repetitive_sequences_end():
    began = time.monotonic()
    assert periods.runs_of(np.zeros(300_000, dtype=np.int64)) == [(0, 300_000, 1)]
    assert periods.runs_of(np.arange(300_000) % 1000) == [(0, 300_000, 1000)]
    assert len(periods.runs_of(np.arange(300_000) // 100)) == 3000
    one, two = [0], [0, 1]
    while len(two) < 40_000:
        one, two = two, two + one
    assert len(periods.runs_of(np.array(two))) > 5000
    assert time.monotonic() - began < 40


def test_edges(spark):
    rows = [(1, "a b " * 8, 1), (1, "a b " * 8, 2), (2, None, 1), (3, "", 1), (None, "x " * 12, 1), (4, " \n\t", None), (5, "x " * 11, 1), (6, "A a " * 6 + "end", 1), (7, "w x " * 12, 1)]
    found = periods.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, runs long")).collect()
    by = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found}
    assert len(found) == len(rows) and sum(r.doc_id == 1 for r in found) == 2
    assert by[1] == (16, [(0, 16, 2)], "a b") and by[2] == by[3] == by[4] == (0, [], "")
    assert by[None] == (12, [(0, 12, 1)], "x") and by[5] == (11, [], "x " * 10 + "x")
    assert by[6] == (13, [(0, 12, 2)], "A a end") and by[7] == (12, [(0, 12, 1)], "w x")
    assert periods.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_equals_brute_force(spark):
    found = {r.doc_id: r for r in periods.op11_runs(spark, DATA).collect()}
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(rows)
    several = 0
    for doc, text in rows:
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(doc).encode()), len(words)
        if n > 2500:
            continue
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute(words, 12)
        several += len(runs) > 1
        top = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
        drop = {i for s, m, q in runs for i in range(s + q, s + m)}
        r = found[doc]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *top)
        assert r.exponent_milli == (1000 * top[1] // top[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in drop)).hexdigest()
    assert several and len([r for r in found.values() if r.n_runs]) > 10
