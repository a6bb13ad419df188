"""Every operator against a brute-force version, on odd rows and on the smallest given table."""

import base64
import os
import random

import brute
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken

import corpus_pipeline
from logharrow.llm import bpe, hashing, lines, mixing, ngram_join, pii, quality, queries, suffixes, tokens, warc
from logharrow.llm.exact import DigestIndex
from logharrow.session import work_dir

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = " ".join(f"word{i} makes sense{i % 7}." for i in range(60))
ODD = [
    (1, PROSE, "en", "a", 1), (2, PROSE.replace(" ", "\n"), "en", "a", 1), (3, PROSE + " extra", None, None, None),
    (4, None, "en", "b", 0), (5, "", "en", "", 0), (6, " \t\n\x0b ", "en", "a", 3), (7, "one", "en", "ä", 3),
    (8, "One", "en", "ä", 3), (8, "One", "en", "ä", 3), (None, "two words", "en", "a", 3), (None, PROSE, None, None, 5),
    (9, "x" * 70_000, "en", "long", 70_000), (10, "ab " * 20_000, "en", "long", 60_000), (-5, PROSE[:-2] + "..", "en", "z", 2),
    (11, "a@b.cc_x@d.ee, 1.2.3.4.5.6.7.8 and 999.1.1.1; 4111 1111 1111 1111 +1 (017) 555-7713 +12", "en", "z", 2),
    (12, "naïve ▁ café  　 <s>😀</s> \x00 tab\tend ", "fr", "\U0001f600", 9), (13, "line one here.\nline one hare.\nline one here.\nlin one here.", "en", "￿", 9),
    (14, "9" * 3000 + " " + "1-" * 2000 + ".1" * 900, "en", "a", 9), (15, "a b c\r\na b c", "en", "b", 9),
]


@pytest.fixture(scope="module")
def given(spark):
    if not os.path.isdir(SF):
        pytest.skip("test data not present")
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module", params=["odd", "given", "empty", "clash"])
def docs(request, spark, odd):
    """Odd rows, the given table, no rows, and odd rows among columns named like inner ones."""
    if request.param == "given":
        return request.getfixturevalue("given")
    if request.param == "empty":
        return spark.createDataFrame([], SCHEMA)
    if request.param == "clash":
        return odd.selectExpr(
            "*", "1 AS id", "2 AS block", "3 AS row", "4 AS words", "5 AS base", "6 AS key", "7 AS _row", "8 AS size",
            "9 AS _digest", "10 AS _copies", "11 AS lines", "12 AS label", "13 AS payload", "14 AS kept", "15 AS _gone",
        )
    return odd


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def result(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def test_ngram_join(docs):
    rule = ngram_join.Jaccard(3, 90, 100)
    got = result(ngram_join.ngram_components(docs, rule), "doc_id", "n_shingles", "component_id")
    assert got == brute.components(rows_of(docs), 3, 90, 100)


@pytest.mark.parametrize("boundary", [0, 40, 400])
def test_ngram_join_at_any_boundary(spark, monkeypatch, boundary):
    """Light and heavy sets, and those on the border, find the same links; also with tiny slots."""
    draw = random.Random(3)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(150):
        start, size = draw.choice([0, 50, 200]), draw.choice([8, 12, 30, 60, 120])
        words = base[start : start + size]
        for _ in range(draw.randrange(3)):
            words[draw.randrange(len(words))] = draw.choice("xyz")
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "light_boundary", lambda *_: boundary)
    monkeypatch.setattr(ngram_join, "PARTNERS", 3)
    got = result(ngram_join.ngram_components(docs, ngram_join.Jaccard(2, 70, 100)), "doc_id", "n_shingles", "component_id")
    assert got == brute.components(rows, 2, 70, 100)


def test_jaccard_refuses_half():
    with pytest.raises(ValueError):
        ngram_join.Jaccard(3, 50, 100)


def test_exact_dedup(spark, docs):
    index = DigestIndex(spark, f"t{random.getrandbits(60)}", work_dir(spark, "index"), 4)
    got = result(index.add(docs, "a"), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    groups = {}
    plain = lambda t: "".join(brute.WORDS.findall(t or ""))
    for key, text in rows_of(docs):
        groups.setdefault(plain(text), []).append((-len(text or ""), key is None, key or 0, key))
    expected = []
    for key, text in rows_of(docs):
        group = groups[plain(text)]
        keep = min(group)[3]
        expected.append((key, keep, len(group), key == keep, brute.sha(plain(text))))
    assert got == sorted(expected, key=str)


def test_exact_dedup_over_loads(spark, odd):
    index = DigestIndex(spark, f"t{random.getrandbits(60)}", work_dir(spark, "index"), 4)
    first = odd.where("doc_id < 5")
    one = result(index.add(first, "one"), "doc_id", "keep_id", "kept")
    again = result(index.add(first, "one"), "doc_id", "keep_id", "kept")
    assert one == again and index.rows().count() == len({r[1] for r in one})
    both = index.add(odd, "two")
    assert not both.where("kept AND doc_id IN (1, 2, 3, 4)").count()
    stays = {r.doc_id for r in index.new_documents(odd.where("doc_id = 8 OR doc_id = 7"), "three").collect()}
    assert stays == set()
    assert index.rows().count() == index.rows().select("digest").distinct().count()


def test_new_documents_keeps_one_of_repeated_rows(spark, docs):
    index = DigestIndex(spark, f"t{random.getrandbits(60)}", work_dir(spark, "index"), 4)
    left = index.new_documents(docs, "a")
    assert left.columns == docs.columns
    texts = ["".join(brute.WORDS.findall(r.text or "")) for r in left.select("text").collect()]
    assert sorted(texts) == sorted({"".join(brute.WORDS.findall(t or "")) for _, t in rows_of(docs)})


def test_token_counts(docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = result(tokens.token_counts(docs, path, limit=300), "doc_id", "n_bytes", "n_tokens", "over_limit")
    expected = [(k, len((t or "").encode()), len(sp.encode(t or ""))) for k, t in rows_of(docs)]
    assert got == sorted(((*r, r[2] > 300) for r in expected), key=str)


@pytest.mark.parametrize("text", ["", " ", "  ", "a ", " a", "a  b ", "a   ", "▁", "a▁▁b", "\n a", "é  ﬁ", "a \n b"])
def test_pre_tokens(text):
    sp, cut = tokens.model(public_tokenizers.path("piece_bpe_32k.model"))
    known = tokens.Lengths({}, sp)
    assert cut and sum(known[p] for p in tokens.pre_tokens(text)) == len(sp.encode(text))


def test_mixing(spark, docs):
    got = mixing.mix_sources(docs).collect()
    sizes = {}
    for r in docs.select("source", "text").collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(brute.WORDS.findall(r.text or ""))
    goal = brute.targets(sizes)
    assert len(got) == docs.count()
    taken, largest = {}, {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    for source, n in taken.items():
        assert abs(n - goal[source]) <= largest[source] + 1e-6
    again = mixing.mix_sources(docs.repartition(5))
    assert result(again, "doc_id", "size", "taken") == sorted(((r.doc_id, r["size"], r.taken) for r in got), key=str)
    mix = mixing.mixed_documents(docs)
    assert mix.columns == docs.columns and mix.count() == sum(r.copies for r in got)


def test_mixing_keeps_expectations(monkeypatch):
    draw = random.Random(5)
    total = 0.0
    for _ in range(4000):
        one, two = {"size": 3, "p": 0.5}, {"size": 7, "p": 0.4}
        mixing.exchange(one, two, draw)
        assert 3 * one["p"] + 7 * two["p"] == pytest.approx(4.3)
        assert mixing.settled_at(one["p"]) or mixing.settled_at(two["p"])
        total += one["p"]
    assert total / 4000 == pytest.approx(0.5, abs=0.03)


PAGES = [
    (5, "http://x/1", "<p>" + "same text " * 30), (3, "http://x/2\r\nInjected: yes", "<p>" + "same text " * 30), (4, None, None),
    (6, "u", ""), (7, "u", "short"), (8, "u", "short"), (None, "u", "<p>" + "same text " * 30), (9, "ü", "é" * 60), (10, "u", "é" * 60),
    (11, "u", "big " * 100_000), (3, "http://x/2", "<p>" + "same text " * 30), (12, "u", "WARC/1.1\r\n\r\n\x1f\x8b\x08 " * 20),
]


@pytest.mark.parametrize("split", [64, 700, 1 << 20])
def test_warc_round_trip(spark, split):
    folder = work_dir(spark, "warc")
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    assert warc.write_warc(pages, folder) == len(PAGES)
    records = warc.read_warc(spark, folder, split)
    got = sorted((tuple(r) for r in warc.page_records(records).collect()), key=str)
    low = {}
    for key, _, html in PAGES:
        data = (html or "").encode()
        if len(data) >= 100 and key is not None:
            low[data] = min(key, low.get(data, key))
    expected = []
    for key, _, html in PAGES:
        data = (html or "").encode()
        first = low.get(data)
        refers = first if first is not None and key != first else None
        expected.append((key, len(data), brute.sha(data), "revisit" if refers is not None else "response", refers))
    assert got == sorted(expected, key=str)
    whole = {r.record_id: bytes(r.payload).decode() for r in records.where("record_type = 'response'").collect()}
    assert whole["urn:page:11"] == "big " * 100_000 and whole["urn:page:4"] == ""


def test_warc_of_no_pages(spark):
    folder = work_dir(spark, "warc")
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write_warc(empty, folder) == 0


def test_warc_search_passes_false_magic(tmp_path):
    """A reader put down inside a member whose stored bytes look like members finds the next one."""
    fake = warc.record(1, "x", "u", b"inner", brute.sha(b"inner"), None, "d")
    noise = np.random.default_rng(0).bytes(3000)
    first = warc.record(2, "x", "u", noise + fake[: len(fake) // 2] + b"\x1f\x8b\x08" + noise, "", None, "d")
    second = warc.record(3, "x", "u", b"after", "", None, "d")
    (tmp_path / "a").write_bytes(first + second)
    store, name = warc.open_store(str(tmp_path / "a"))
    size = len(first + second)
    with store.open_input_file(name) as source:
        for cut in (1, 500, 3000, len(first) - 1, len(first)):
            assert [at for at, *_ in warc.members(source, cut, size, size)] == [len(first)]
        assert [at for at, *_ in warc.members(source, 0, 10, size)] == [0]


def test_personal_data(docs):
    found = pii.personal_data(docs)
    got = result(found, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert got == sorted(((k, *brute.personal(t)) for k, t in rows_of(docs)), key=str)


def test_redaction(spark):
    text = "Mail a.b@c.org or +1 (017) 555-7713."
    row = pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.redacted_text == "Mail [email] or [phone]." and row.spans == "email:5:14,phone:18:35"


def test_added_spans_are_learnt(spark):
    """Numbers written like the phone numbers found, but without a plus, are added; dates are not."""
    draw = random.Random(1)
    number = lambda: f"({draw.randrange(200, 999)}) {draw.randrange(200, 999)}-{draw.randrange(1000, 9999)}"
    rows = [(i, f"please call +1 {number()} today, room {draw.randrange(10, 99)}") for i in range(400)]
    rows += [(1000 + i, f"please call {number()} today, room {draw.randrange(10, 99)}") for i in range(10)]
    rows += [(2000 + i, f"lot {draw.randrange(10, 99)}-{draw.randrange(100, 999)}-{draw.randrange(100, 999)} of stock") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(docs, training=pii.Training(precision=0.95)).collect()}
    assert all(got[i].n_phone == 1 for i in range(400))
    assert sum(got[1000 + i].n_added for i in range(10)) >= 8
    assert sum(got[2000 + i].n_added for i in range(300)) <= 6


def card_number(draw, size):
    """A number of some digits that passes the check sum of cards."""
    head = "4" + "".join(str(draw.randrange(10)) for _ in range(size - 2))
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(head))))
    return head + str(-total % 10)


def planted_personal_data(n):
    """Texts with base spans, and as many disguised ones of each kind; ids in tens of thousands by form."""
    draw = random.Random(3)
    name = lambda: f"{draw.choice(['ann', 'bob', 'eve'])}{draw.randrange(999)}"
    part = lambda: draw.randrange(1, 255)
    forms = [
        lambda: f"please write to {name()}@mail.example.com for more",
        lambda: f"please write to {name()}[at]mail[dot]example[dot]com for more",
        lambda: f"login from host {part()}.{part()}.{part()}.{part()} failed",
        lambda: f"login from host {part()}[.]{part()}[.]{part()}[.]{part()} failed",
        lambda: "pay by card {}-{}-{}-{} today".format(*(lambda c: (c[:4], c[4:8], c[8:12], c[12:]))(card_number(draw, 16))),
        lambda: "pay by card {}.{}.{}.{} today".format(*(lambda c: (c[:4], c[4:8], c[8:12], c[12:]))(card_number(draw, 16))),
        lambda: "pay by card {}-{}-{}-{} today".format(*(lambda c: (c[:4], c[4:8], c[8:12], c[12:]))(card_number(draw, 14))),
        lambda: f"please call +49 {draw.randrange(200, 999)} {draw.randrange(200, 999)} {draw.randrange(1000, 9999)} today",
        lambda: f"please call {draw.randrange(200, 999)} {draw.randrange(200, 999)} {draw.randrange(1000, 9999)} today",
    ]
    rows = [(10_000 * k + i, form()) for k, form in enumerate(forms) for i in range(n)]
    wrong = [
        lambda: f"login from host {draw.randrange(300, 999)}.{part()}.{part()}.{part()} failed",
        lambda: "pay by card {} today".format(str(int(card_number(draw, 16)) // 10 * 10 + (int(card_number(draw, 1 + 15)[-1]) + 1) % 10)),
    ]
    return rows, [(900_000 + 10_000 * k + i, form()) for k, form in enumerate(wrong) for i in range(n)]


@pytest.mark.parametrize("n", [12, 120])
def test_disguised_spans_are_added(spark, n):
    """Half and more of the spans of each kind are disguised; few as they may be, they are found."""
    rows, wrong = planted_personal_data(n)
    docs = spark.createDataFrame(rows + wrong, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    share = {k: sum(got[10_000 * k + i].n_added for i in range(n)) / n for k in (1, 3, 5, 6, 8)}
    assert min(share.values()) >= 0.9, share
    failing = [k for k, text in wrong if not any(map(brute.personal(text)[:4].__getitem__, range(4)))]
    assert not sum(got[k].n_added for k in failing)


def test_thresholds():
    """From all known ones of a kind, drawn towards a default by the same formula at every size."""
    how = pii.Training()
    assert pii.precise_level([], how) == 500
    few, more, many = (pii.precise_level([(990, 60 * n, 60 * n), (900, 38 * n, 38 * n), (300, 2 * n, 2 * n), (100, 0, 50 * n)], how) for n in (0.1, 1, 100))
    assert 500 < few < more < many and many in (899, 900)
    steps = [pii.precise_level([(900, n, n)], how) for n in range(60)]
    assert all(0 <= b - a <= 20 for a, b in zip(steps, steps[1:]))
    assert pii.precise_level([(990, 10_000, 500_000), (100, 50_000, 500_000)], how) > 998


def test_quality_rules(docs):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = result(quality.quality_rules(docs), "doc_id", *names)
    assert got == sorted(((k, *brute.quality(t)) for k, t in rows_of(docs)), key=str)
    kept = quality.good_documents(docs)
    assert kept.columns == docs.columns


def test_quality_verdicts(given, spark):
    """On held labels: poor documents go, and good ones that pass the base rules stay."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.quality_rules(given).join(labels, "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    poor = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(r.kept for r in poor) <= 0.05 * len(poor)


@pytest.mark.parametrize(
    "line,fails",
    [
        ("A plain sentence stands here.", False), ("Was it so? Yes", False), ("Home | News | Sport | About", True),
        ("no sentence end in these words", True), ("We use a cookie policy. Accept all cookies.", True), ("Good*** text### here.***", True),
    ],
)
def test_line_rules(spark, line, fails):
    row = spark.createDataFrame([(line,)], "line string").select(quality.line_fails(quality.F.col("line"))).first()
    assert row[0] is fails


def test_line_dedup(docs):
    got = result(lines.line_dedup(docs), "doc_id", "n_lines", "n_equal", "n_near", "kept_sha256")
    assert got == brute.lines(rows_of(docs))


def test_line_dedup_of_random_lines(spark):
    draw = random.Random(9)
    rows = [(i, "\n".join("".join(draw.choice("ab") for _ in range(draw.randrange(1, 9))) for _ in range(3))) for i in range(120)]
    long = "some long line of text that is cut in segments, with ünïcode 😀"
    for i in range(40):
        at = draw.randrange(len(long))
        rows.append((500 + i, draw.choice([long[:at] + long[at + 1 :], long[:at] + "x" + long[at:], long[:at] + "y" + long[at + 1 :]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = result(lines.line_dedup(docs), "doc_id", "n_lines", "n_equal", "n_near", "kept_sha256")
    assert got == brute.lines(rows)


def test_repeated_bytes(docs):
    got = result(suffixes.repeated_bytes(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.repeats(rows_of(docs))


def test_repeated_bytes_of_random_texts(spark, monkeypatch):
    """Small alphabets, small pieces and portions: ties, periods and cuts everywhere."""
    for name, value in (("PIECE", 200), ("TRANSFORM_BYTES", 500), ("PART_BYTES", 4000)):
        monkeypatch.setattr(suffixes, name, value)
    draw = random.Random(4)
    pool = ["".join(draw.choice("abc\x00é") for _ in range(draw.randrange(30, 300))) for _ in range(12)] + ["ab" * 150, "a" * 200]
    rows = [(draw.randrange(60), "".join(draw.choice(pool)[draw.randrange(9) :] for _ in range(draw.randrange(1, 4)))) for _ in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = result(suffixes.repeated_bytes(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.repeats(rows)


def test_repeated_bytes_around_a_hot_anchor(spark, monkeypatch):
    """One phrase among ever different neighbours: no transform takes more than some of its surroundings."""
    for name, value in (("HOT", 50), ("PART_BYTES", 20_000)):
        monkeypatch.setattr(suffixes, name, value)
    draw = random.Random(8)
    phrase = "a phrase of the template \x00 that all have"
    word = lambda n: "".join(draw.choice("abcdefgh") for _ in range(n))
    ends = [word(40) for _ in range(30)]
    rows = [(draw.randrange(900), word(40) + phrase + (draw.choice(ends) if i % 3 else word(40))) for i in range(600)]
    rows += [(None, rows[0][1]), (None, rows[1][1][:70]), (5000, rows[2][1] * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = []
    hot = suffixes._hot_anchors
    monkeypatch.setattr(suffixes, "_hot_anchors", lambda df: found.append(hot(df)) or found[-1])
    got = result(suffixes.repeated_bytes(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.repeats(rows)
    assert len(found[0][0]) and found[0][1] > 500


@pytest.mark.parametrize("copied", [True, False])
def test_repeated_bytes_stores_less_than_the_texts(spark, monkeypatch, copied):
    """Where strings lie is stored, not the strings; bytes around an anchor that no other document has are not compared."""
    draw = random.Random(11)
    word = lambda n: "".join(draw.choice("abcdefghijklmnop") for _ in range(n))
    phrases = [word(24) for _ in range(40)]  # short of a string of 50 bytes, and of its half
    texts = ["".join(word(40) + draw.choice(phrases) for _ in range(50)) for _ in range(60)]
    rows = list(enumerate(texts + [t[100:] for t in texts] * copied))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    stored, settled = [], suffixes.settled

    def measured(df, purpose):
        out = settled(df, purpose)
        stored.append(sum(os.path.getsize(f.removeprefix("file:")) for f in out.inputFiles()))
        return out

    monkeypatch.setattr(suffixes, "settled", measured)
    got = result(suffixes.repeated_bytes(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.repeats(rows)
    assert sum(stored) < sum(len(t) for _, t in rows) * (0.9 if copied else 0.2)


def test_first_of_tied_windows_is_the_anchor():
    """In a text of a short period most windows are tied: a string has one anchor even so."""
    for unit in (b"a", b"Eau ", b"abcdefghijk"):
        text = np.frombuffer(unit * 50, np.uint8)
        _, first, last, *_ = suffixes.anchors(text, np.array([len(text)]), 50)
        assert (last - first + 1).sum() == len(text) - 49
        assert first.tolist() == [0, *(last[:-1] + 1)]


def test_numbers_in_planes_come_back():
    draw = random.Random(3)
    for kind in (np.int32, np.int64, np.uint32):
        bounds = np.iinfo(kind)
        for n in (0, 1, 50):
            values = np.array([draw.choice([bounds.min, bounds.max, 0, 1, 5, 70_000]) for _ in range(n)], kind)
            assert suffixes.from_planes(np.frombuffer(suffixes.planes(values).tobytes(), np.uint8), kind).tolist() == values.tolist()


def test_repeated_bytes_where_every_anchor_is_hot(spark, monkeypatch):
    """Then blocks have no surroundings to compare; what repeats inside a block goes even so."""
    draw = random.Random(9)
    texts = ["".join(draw.choice("abcdefgh") for _ in range(300)) for _ in range(6)]
    rows = [(i, texts[i % 6][i % 4 * 9 :]) for i in range(40)] + [(None, texts[0]), (7, texts[1])]
    every = []
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        every.append(suffixes.hashes_at(data, suffixes.anchors(data, np.array([len(data)]), 50)[0]))
    monkeypatch.setattr(suffixes, "_hot_anchors", lambda df: (np.unique(np.concatenate(every)), 100))
    for parts in (1, 3):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = result(suffixes.repeated_bytes(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert got == brute.repeats(rows)


def test_transform_gives_common_prefixes():
    draw = random.Random(2)
    for size in (1, 2, 5, 40, 300):
        text = np.frombuffer(bytes(draw.choice(b"ab") for _ in range(size)), np.uint8)
        order = suffixes.suffix_order(text)
        raw = text.tobytes() * 70
        spun = [raw[i : i + 64] for i in order]
        assert spun == sorted(spun)
        edge = suffixes.prefix_edges(text[order - 1], 50)
        assert edge.tolist() == [i == 0 or spun[i][:50] != spun[i - 1][:50] for i in range(size)]


@pytest.fixture(scope="module")
def encoding():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(docs, encoding):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.byte_bpe(docs, path, public_tokenizers.PATTERN)
    expected = []
    for key, text in rows_of(docs):
        ids = encoding.encode_ordinary(text or "")
        expected.append((key, len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(text or ""), ids))
    assert result(coded, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids") == sorted(expected, key=str)
    back = bpe.decode_ids(coded, path)
    assert result(back, "doc_id", "text") == sorted(((k, t or "") for k, t in rows_of(docs)), key=str)


def test_byte_bpe_of_any_bytes(encoding):
    codec = bpe.Codec(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    draw = random.Random(6)
    known = list(codec.ranks)
    for _ in range(4000):
        kind = draw.random()
        if kind < 0.5:
            piece = b"".join(draw.choice(known) for _ in range(draw.randrange(1, 7)))
        else:
            piece = bytes(draw.choice(b"abcthe  aeiou" if kind < 0.8 else range(256)) for _ in range(draw.randrange(1, 40)))
        ids = codec.encode(piece)
        assert codec.decode(ids) == piece
        assert ids == encoding.encode_single_token(piece) if piece in codec.ranks and isinstance(ids, int) else ids == encoding._encode_single_piece(piece)


def test_ranks_without_all_bytes_are_refused():
    with pytest.raises(ValueError):
        bpe.Codec({b"a": 0})


def test_rank_file_reading(tmp_path):
    (tmp_path / "r").write_bytes(base64.b64encode(b"ab") + b" 7\n")
    assert bpe.read_ranks(str(tmp_path / "r")) == {b"ab": 7}


def test_shingles_do_not_depend_on_pieces():
    text = (PROSE + " ") * 30
    whole = hashing.shingle_sets(text.encode(), [len(text)], 3)[0]
    cut = hashing._shingles(hashing._long_hashes(np.frombuffer(text.encode(), np.uint8), 500), 3)
    assert whole.tolist() == cut.tolist()


def test_pipeline(spark, docs):
    """Each stage on its own input, by brute force."""
    stages = [f for _, f in corpus_pipeline.STAGES]
    good = stages[0](spark, docs, SF)
    verdict = result(quality.quality_rules(docs), "doc_id", "kept")
    assert result(good, "doc_id") == sorted(((k,) for k, kept in verdict if kept), key=str)
    unique = stages[1](spark, good, SF)
    assert unique.columns == docs.columns
    plain = ["".join(brute.WORDS.findall(r.text or "")) for r in unique.collect()]
    assert len(plain) == len(set(plain)) and set(plain) == {"".join(brute.WORDS.findall(t or "")) for _, t in rows_of(good)}
    apart = stages[2](spark, unique, SF)
    leaders = {k for k, _, c in brute.components(rows_of(unique), 5, 80, 100) if k == c}
    assert {r.doc_id for r in apart.collect()} == leaders and apart.columns == docs.columns
    mix = stages[3](spark, apart, SF)
    assert mix.columns == docs.columns
    last = stages[4](spark, mix, SF)
    assert last.count() == mix.count()


def test_pipeline_run(spark, given):
    done = corpus_pipeline.run(spark, SF)
    ids = {r.doc_id for r in done.collect()}
    assert ids and ids <= {r.doc_id for r in given.collect()}


def test_queries_are_whole():
    numbers = {name.split("_")[0] for name in queries.QUERIES}
    assert numbers == {f"op{n}" for n in range(1, 14)}
