"""Ranked search against scoring every document, at any size of shards, windows and short lists."""

import math
import random
import re
from collections import Counter

import pytest

from logharrow.llm import search
from logharrow.llm.search import Ranking

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def fold(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=20):
    held = [(key, Counter(fold(text))) for key, text in docs]
    sizes = [sum(c.values()) for _, c in held]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        rows = []
        for (key, c), size in zip(held, sizes):
            m = 75 + 25 * size * n // total if total else 0
            score = 0
            for t, k in Counter(fold(text)).items():
                if t in c:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += k * w * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                rows.append((score, key))
        rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        out += [(item, i + 1, key, score) for i, (score, key) in enumerate(rows[:top])]
    return sorted(out, key=str)


def answer(spark, docs, items, **how):
    got = search.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), Ranking(**how))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def made(n, seed, copies=0):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(draw.randrange(-50, 10 * n), " ".join(draw.choices(words, weights, k=draw.randrange(0, 60)))) for _ in range(n)]
    return docs + [(10 * n + i, docs[0][1] + " w0 w1 w2 w7") for i in range(copies)]


@pytest.mark.parametrize("short, window, shard, skip", [(0, 16, 3000, 4), (5, 64, 900, 8), (10_000, 1024, 8 << 20, 64), (40, 8, 8 << 20, 2)])
def test_any_layout_gives_the_same_rows(spark, monkeypatch, short, window, shard, skip):
    for name, value in (("SHORT_LIST", short), ("WINDOW", window), ("SHARD_BYTES", shard), ("SKIP", skip)):
        monkeypatch.setattr(search, name, value)
    docs = made(700, 1, copies=60)
    draw = random.Random(9)
    items = [(i % 9, " ".join(draw.choices([f"W{k}" for k in range(320)], k=draw.randrange(0, 40)))) for i in range(25)]
    assert answer(spark, docs, items) == brute(docs, items)


def test_tiny_windows_skip(spark, monkeypatch):
    """Most windows are never looked into once the best rows are known."""
    seen = []
    window = search.Shard._window
    monkeypatch.setattr(search, "WINDOW", 8)
    monkeypatch.setattr(search, "SHORT_LIST", 3)
    monkeypatch.setattr(search.Shard, "_window", lambda self, *a: (seen.append(a[0]), window(self, *a)))
    docs = [(i, "common " * (40 if i < 30 else 1) + "filler " * 9) for i in range(800)]
    index = search.build_index(spark.createDataFrame(docs, DOCS).coalesce(1)).collect()[0]
    import pyarrow as pa

    row = {k: pa.array([v], pa.list_(pa.int64()) if k == "ids" else pa.binary())[0] for k, v in index.asDict().items()}
    shard = search.Shard(row, {b"common"}, Ranking(), (800, 30 * 49 + 770 * 10))
    best = search.Best(20)
    shard.walk({b"common": 5}, best)
    assert len(seen) < 10 and [k for k, _ in best.rows()] == list(range(20))


def test_odd_rows(spark):
    docs = [
        (1, None), (2, ""), (3, " .,! "), (None, "été Éa x1"), (None, "été"), (4, "ÉA éa été"), (5, "x1 " * 50_000), (6, "y" * 1_500_000 + " x1"),
        (7, "x1"), (7, "x1"), (-8, "X1"), (9, "naïve_x1-X1"),
    ]
    items = [(1, "été x1 x1"), (1, "ÉA"), (None, "X1"), (2, None), (3, ""), (4, "unseen words"), (5, "y" * 1_500_000)]
    assert answer(spark, docs, items) == brute(docs, items)


def test_one_term_longer_than_a_piece(monkeypatch):
    monkeypatch.setattr(search, "PIECE_BYTES", 7)
    text = "ab " + "é" * 30 + " Cd,e" + "f" * 20
    assert [t.decode() for piece in search.terms_of(text) for t in piece] == fold(text)


def test_empty_tables_and_clashing_names(spark):
    docs, items = [(1, "one two"), (2, "two")], [(1, "two")]
    assert answer(spark, [], items) == [] and answer(spark, docs, []) == [] and answer(spark, [(1, None)], items) == []
    clash = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS id", "2 AS ids", "3 AS score", "4 AS number", "5 AS rank")
    asked = spark.createDataFrame(items, ITEMS).selectExpr("*", "1 AS item", "2 AS number", "3 AS size", "4 AS doc_id")
    assert sorted(map(tuple, search.search(clash, asked).collect())) == brute(docs, items)


def test_many_items_in_passes(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BYTES", 60)
    docs = made(60, 4)
    items = [(i, f"w{i} w{i + 1} w0") for i in range(30)]
    assert answer(spark, docs, items, top=3) == brute(docs, items, 3)
