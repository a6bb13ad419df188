"""Language of texts: forward-backward against all paths, held-out accuracy, switched texts, odd rows."""

import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from logharrow.llm import language, queries
from logharrow.llm.language import Training, fit_language_model, label_words, marginals, predict_language, words_of

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def given(spark):
    if not os.path.isdir(SF):
        pytest.skip("test data not present")
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(given):
    return fit_language_model(given.where("doc_id % 3 <> 1"))


@pytest.mark.parametrize("length", [1, 2, 5])
def test_marginals_are_those_of_all_paths(length):
    draw = np.random.default_rng(length)
    e, moves = draw.normal(0, 2, (length, 3)), draw.normal(0, 2, (3, 3))
    want, total = np.zeros((length, 3)), 0.0
    for path in itertools.product(range(3), repeat=length):
        p = np.exp(sum(e[t, k] for t, k in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        total += p
        for t, k in enumerate(path):
            want[t, k] += p
    got = marginals([e, e[:1]], moves)
    np.testing.assert_allclose(got[0], want / total, atol=1e-9)


def test_long_texts_in_segments_are_exact(monkeypatch):
    draw = np.random.default_rng(5)
    texts = [draw.normal(0, 2, (n, 4)) for n in (1, 40, 700, 3, 0, 333)]
    moves = draw.normal(0, 2, (4, 4))
    monkeypatch.setattr(language, "SEGMENT", 10_000)
    whole = marginals(texts, moves)
    monkeypatch.setattr(language, "SEGMENT", 7)
    for a, b in zip(whole, marginals(texts, moves)):
        np.testing.assert_allclose(a, b, atol=1e-9)


def test_features_of_a_word_do_not_depend_on_its_place():
    alone = words_of(np.frombuffer("straße".encode(), np.uint8))
    text = words_of(np.frombuffer("ab, 12 straße; été".encode(), np.uint8))
    assert [(a, b) for a, b in zip(text.starts, text.ends)] == [(0, 2), (7, 14), (16, 21)]
    assert (text.own[1] == alone.own[0]).all() and text.slots[1] == alone.slots[0]
    assert (text.grams[text.first[1] : text.first[2]] == alone.grams).all()


def test_pieces_lose_no_word(monkeypatch, model):
    text = " ".join(f"thing{i} ündé" for i in range(200)) + "x" * 500
    want = language._text_emissions(text, model)
    monkeypatch.setattr(language, "PIECE_BYTES", 37)
    for a, b in zip(want, language._text_emissions(text, model)):
        np.testing.assert_allclose(a, b, atol=1e-4)


def test_equal_words_get_their_features_once(monkeypatch, model):
    texts = ["The cat, the été", "the", "xthe the thex" * 3, "… 1 é", ""]
    data = language._joined([language.folded(t).encode() for t in texts])
    every = words_of(data)
    words, same, starts, ends = language.distinct_words(data)
    assert len(words.starts) == len({bytes(data[a:b]) for a, b in zip(starts, ends)}) < len(same) == len(every.starts)
    assert (starts == every.starts).all() and (ends == every.ends).all()
    assert (words.own[same] == every.own).all() and (words.slots[same] == every.slots).all()
    assert (language.word_slots(data) == every.slots).all()
    want = [language._text_emissions(t, model)[3] for t in texts]
    for a, b in zip(want, language._each_emissions(texts, model)):
        np.testing.assert_allclose(a, b, atol=1e-5)
    # Words whose hashes meet are not taken for one.
    real = language._hashes
    monkeypatch.setattr(language, "_hashes", lambda *args: real(*args) * np.uint64(0))
    words, same, *_ = language.distinct_words(data)
    assert len(words.starts) == len(every.starts) and (words.own[same][:, :4] == every.own[:, :4]).all()


def test_held_out_accuracy(given, model):
    rows = predict_language(given, model).join(given.select("doc_id", "lang"), "doc_id").where("doc_id % 3 = 1")
    right, n = rows.agg(F.sum(F.expr("int(lang = lang_pred)")), F.count("*")).first()
    assert n > 50 and right >= 0.98 * n


def test_query_learns_from_rows_that_are_not_held_out(spark, given):
    rows = queries.op11_language_id(spark, SF).collect()
    assert len(rows) == given.count()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_switched_text(spark, given, model):
    texts = {r.lang: r.text for r in given.where("doc_id % 3 = 1 AND n_chars BETWEEN 500 AND 3000").collect()}
    one, two = (" ".join(texts[k].split()[:40]) for k in ("en", "de"))
    docs = spark.createDataFrame([(1, f"{one} {two}", None)], SCHEMA)
    spans = label_words(docs, model).first().spans
    covered = {k: sum(s.end - s.start for s in spans if s.lang == k) for k in ("en", "de")}
    assert covered["en"] > 0.9 * len(one) - 20 and covered["de"] > 0.9 * len(two) - 20
    inside = [s for s in spans if s.start < len(one) < s.end]
    assert all(len(one) - s.start < 60 or s.end - len(one) < 60 for s in inside)


ODD = [
    (1, None, "en"), (2, "", "en"), (3, "123 !? --", "fr"), (4, "…😀", None), (None, "the thing of the", "en"), (5, "É", "fr"),
    (6, "the " * 60_000, "en"), (7, "x" * 100_000, None), (7, "x", None), (7, "x", None), (8, "İstanbul ǅ", ""),
]


def test_odd_rows(spark, model):
    docs = spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "1 AS id", "2 AS score", "3 AS size", "4 AS n_words")
    rows = predict_language(docs, model).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ODD)
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1, 2, 3, 4))
    assert by_id[5].lang_pred in model.labels and by_id[6].lang_pred == "en" and by_id[6].n_words == 60_000
    for r in label_words(docs, model).collect():
        assert all(s.start < s.end and 0 <= s.score <= 1.0000001 for s in r.spans)


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert fit_language_model(empty) is None
    docs = spark.createDataFrame([(1, "some words", None), (2, None, "en")], SCHEMA)
    none = fit_language_model(docs)
    assert none is None
    assert {r.lang_pred for r in predict_language(docs, none).collect()} == {"und"}
    assert predict_language(empty, none).count() == 0


def test_texts_without_words_still_give_their_languages(spark):
    docs = spark.createDataFrame([(1, "12", "en"), (2, "", "fr"), (3, "word", None)], SCHEMA)
    fitted = fit_language_model(docs, Training(rounds=1))
    assert fitted.labels == ["en", "fr"]
    assert {r.doc_id: r.lang_pred for r in predict_language(docs, fitted).collect()} == {1: "und", 2: "und", 3: "en"}


def test_reruns_agree(given, model):
    again = fit_language_model(given.where("doc_id % 3 <> 1").repartition(5))
    np.testing.assert_array_equal(again.weights, model.weights)
    np.testing.assert_array_equal(again.moves, model.moves)
