"""Vector codes against plain rounds with whole numbers of Python."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from logharrow.llm import vector_codes
from logharrow.llm.vector_codes import Lloyd

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max((len(r[1]) for r in kept), default=0) // parts)
    vectors = []
    for key, v, label in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        v = [math.floor(Fraction(x) * scale) for x in v] + [0] * (width * parts - len(v))
        vectors.append((key, label, [tuple(v[p * width : (p + 1) * width]) for p in range(parts)]))
    books = [[v[2][p] for v in vectors[:entries]] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), j) for j, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in vectors:
                groups.setdefault(near(v[2][p], books[p])[1], []).append(v[2][p])
            books[p] = [
                tuple(sum(c) // len(groups[j]) for c in zip(*groups[j])) if j in groups else entry for j, entry in enumerate(books[p])
            ]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    coded = []
    for key, label, cut in vectors:
        best = [near(part, book) for part, book in zip(cut, books)]
        coded.append((key, label, "".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best)))
    most = 2**63 - 1
    total = {}
    for _, label, _, error in coded:
        total[label] = total.get(label, 0) + min(error, most)
    return sorted(((k, c, min(e, most), min(total[label], most), digest) for k, label, c, e in coded), key=str)


def codes(df, **how):
    got = vector_codes.vector_codes(df, Lloyd(**how))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def made(n, dims, seed, spread=1.0):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, spread) for _ in range(dims)] for _ in range(5)]
    return [(draw.randrange(10 * n), [x + draw.gauss(0, spread / 5) for x in draw.choice(centres)], draw.choice([None, 1, 2])) for _ in range(n)]


@pytest.mark.parametrize("n, dims, how", [(300, 16, {}), (90, 24, {"entries": 5, "rounds": 2}), (200, 6, {"parts": 3, "entries": 40, "rounds": 3})])
def test_rounds(spark, n, dims, how):
    rows = made(n, dims, n)
    assert codes(spark.createDataFrame(rows, SCHEMA).repartition(3), **how) == brute(rows, **how)


def test_blocks_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", 37)
    rows = made(400, 8, 7)
    assert codes(spark.createDataFrame(rows, SCHEMA).repartition(4)) == brute(rows)


@pytest.mark.parametrize("grid", [1, 3])
def test_ties_and_copies(spark, grid):
    """Parts on a coarse grid lie between entries; copies hold a third of the rows."""
    draw = random.Random(grid)
    rows = [(i % 150, [float(draw.randrange(-grid, grid + 1)) / 2048 for _ in range(16)], i % 3) for i in range(200)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(100)]
    assert codes(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 1), (2, [1.0, None] + [0.0] * 6, 1), (3, [nan] * 8, 2), (4, [inf] + [0.0] * 7, 2), (5, [-inf] * 8, None), (6, [], 1),
        (7, [0.5] * 8, None), (7, [0.25] * 8, None), (None, [-0.00001] * 8, 3), (8, [1.0] * 5, 3), (9, [2.0] * 11, 3), (9, [2.0] * 11, 3),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS key", "3 AS v", "4 AS error", "5 AS code")
    assert codes(df) == brute(rows)


@pytest.mark.parametrize("scale", [1e12, 1e300])
def test_numbers_beyond_64_bits(spark, scale):
    rows = [(k, [x * scale for x in v], label) for k, v, label in made(60, 8, 3)]
    assert codes(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_empty(spark):
    assert codes(spark.createDataFrame([], SCHEMA)) == []
    assert codes(spark.createDataFrame([(1, None, None)], SCHEMA)) == []
    only = [(1, [], None), (2, [], 1)]
    assert codes(spark.createDataFrame(only, SCHEMA)) == brute(only)


def test_walk_prunes_and_agrees():
    draw = np.random.default_rng(1)
    for _ in range(40):
        n, w, k, top = draw.integers(1, 600), draw.integers(1, 6), draw.integers(1, 17), draw.choice([2, 50, 5000])
        points, entries = draw.integers(-top, top, (n, w)), draw.integers(-top, top, (k, w))
        order, *nodes = vector_codes._tree(points)
        found, sums, counts = vector_codes.nearest(points[order], *nodes, entries)
        want = np.argmin(((points[order][:, None] - entries[None]) ** 2).sum(2), axis=1)
        assert (found == want).all() and (counts == np.bincount(want, minlength=k)).all()
        assert all((sums[e] == points[order][want == e].sum(0)).all() for e in range(k))


def test_clusters_are_assigned_whole(monkeypatch):
    """Far clusters never come down to their leaves."""
    points = np.repeat(np.arange(8)[:, None] * 10_000, 500, 0) + np.random.default_rng(2).integers(0, 50, (4000, 3))
    order, *nodes = vector_codes._tree(points)
    monkeypatch.setattr(vector_codes, "_leaves", lambda *a: pytest.fail("went down to leaves") if len(a[2]) else None)
    _, _, counts = vector_codes.nearest(points[order], *nodes, np.repeat(np.arange(8)[:, None] * 10_000, 3, 1))
    assert (counts == 500).all()
