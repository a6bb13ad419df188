"""Cases that once went wrong: archives in one task, damage passed over, short lines, repeated ids."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from logharrow.llm import lines, mixing, ngram_join, tokens, warc
from logharrow.llm.blocks import block_table
from logharrow.llm.components import components
from logharrow.llm.exact import DigestIndex
from logharrow.session import work_dir

PAGES = "page_id long, url string, html string"
DOCS = "doc_id long, text string, source string"


def archive(spark, n=60, parts=2):
    folder = work_dir(spark, "warc")
    draw = random.Random(1)
    rows = [(i, f"http://h/{i}", "".join(draw.choices("abcdefgh <>é", k=900))) for i in range(n)]
    warc.write_warc(spark.createDataFrame(rows, PAGES).repartition(parts), folder)
    return folder, rows


def test_ranges_are_read_in_many_tasks(spark):
    folder, rows = archive(spark)
    records = warc.read_warc(spark, folder, 2_000)
    ranges = sum(-(-int(r.length) // 2_000) for r in spark.read.format("binaryFile").load(f"{folder}/*.warc.gz").select("length").collect())
    tasks = records.select(F.spark_partition_id().alias("p")).distinct().count()
    assert records.count() == len(rows) and tasks >= min(ranges, 8)


def test_archives_of_no_pages_are_read_back(spark):
    folder = work_dir(spark, "warc")
    assert warc.write_warc(spark.createDataFrame([], PAGES), folder) == 0
    assert warc.page_records(warc.read_warc(spark, folder)).collect() == []


@pytest.mark.parametrize("kind", ["flip", "cut", "junk"])
@pytest.mark.parametrize("split", [300, 5_000, 1 << 20])
def test_damage_is_told(spark, kind, split):
    folder, rows = archive(spark, 12, 1)
    store, root = warc.open_store(folder)
    names = [i.path for i in store.get_file_info(warc.fs.FileSelector(root)) if i.path.endswith(".warc.gz")]
    places = sorted((r.position for r in warc.read_warc(spark, folder).collect()))
    with store.open_input_file(names[0]) as source:
        data = bytearray(source.read())
    if kind == "flip":
        data[places[5] + 200] ^= 0x55
        lost = 1
    elif kind == "cut":
        data, lost = data[:-30], 1
    else:
        data[places[5] : places[5]] = b"not an archive at all"
        lost = 0
    with store.open_output_stream(names[0], compression=None) as out:
        out.write(bytes(data))
    with pytest.raises(Exception, match="no whole record"):
        warc.read_warc(spark, folder, split).collect()
    found = warc.read_warc(spark, folder, split, damaged="report").collect()
    good = [r for r in found if r.record_type != "damaged"]
    bad = [r.position for r in found if r.record_type == "damaged"]
    assert len(good) == len(rows) - lost
    assert bad == [places[-1] if kind == "cut" else places[5]]


def test_a_repeated_task_keeps_the_file_of_the_first(spark, monkeypatch):
    folder, _ = archive(spark, 5, 1)
    before = warc.read_warc(spark, folder).count()
    again, _ = archive(spark, 5, 1)
    store, root = warc.open_store(again)
    names = [i.base_name for i in store.get_file_info(warc.fs.FileSelector(root))]
    assert all(n.endswith(".warc.gz") for n in names) and before == 5


def test_short_lines_stay(spark):
    text = "2018\n2019\nChapter 1\nChapter 2\nIn.\nIt.\nIt.\na long enough line\na lung enough line\n123456789\n1234567890"
    docs = spark.createDataFrame([(1, text, "a")], DOCS)
    row = lines.line_dedup(docs, near_from=lines.NEAR_FROM).first()
    assert (row.n_lines, row.n_equal, row.n_near) == (11, 1, 1)
    assert row.clean_text == text.replace("It.\nIt.", "It.").replace("a lung enough line\n", "")


def test_repeated_and_null_ids_of_one_size(spark):
    """Rows that share id, source and size meet their copies one to one."""
    rows = [(None, f"three words {i}", "hot") for i in range(300)] + [(7, f"three words {i}", "hot") for i in range(200)] + [(1, "a b", "cold")]
    docs = spark.createDataFrame(rows, DOCS)
    mix = mixing.mixed_documents(docs)
    taken = mixing.mix_sources(docs).agg(F.sum("copies")).first()[0]
    assert mix.count() == taken
    most = mix.groupBy("doc_id", "text").count().agg(F.max("count")).first()[0]
    assert most <= mixing.MAX_COPIES
    plan = mix._jdf.queryExecution().optimizedPlan().toString()
    assert "_n#" in next(line for line in plan.splitlines() if "Join Inner" in line)


def leaders(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    got = ngram_join.group_leaders(docs, ngram_join.Jaccard(5, 80, 100), **how)
    assert got.columns == docs.columns
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    words = [f"w{i}" for i in range(100)]
    near = lambda k: " ".join([*words[:-1], f"x{k}"])
    other = " ".join(f"o{i}" for i in range(40))
    rows = [(1, near(1), 0), (None, near(2), 0), (None, other, 0), (7, near(3), 0), (7, other, 1)]
    assert leaders(spark, rows) == [(1, near(1), 0), (7, other, 1)]
    nulls = [(None, near(k), k) for k in range(5)]
    assert len(leaders(spark, nulls)) == 1
    repeated = [(3, near(1), 5)] * 4 + [(3, near(2), 6)] * 2 + [(9, other, 0)]
    assert len(leaders(spark, repeated)) == 2
    wordless = [(1, "", 0), (1, None, 1), (None, " ", 2), (None, None, 3)]
    assert len(leaders(spark, wordless)) == 4


def test_leaders_when_lookups_are_shuffled(spark, monkeypatch):
    from logharrow.operators import lookup

    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(lookup.fits, "__defaults__", (0,))
    draw = random.Random(2)
    texts = [" ".join(f"{g}-{i}" for i in range(60)) for g in range(6)]
    rows = [(draw.randrange(40), texts[draw.randrange(6)] + f" end{draw.randrange(3)}", i) for i in range(120)]
    rows += [(50, texts[0], i) for i in range(60)]
    got = leaders(spark, rows)
    want = {}
    for g in range(6):
        want[g] = min(r[0] for r in rows if r[1].startswith(f"{g}-0 "))
    assert sorted(r[0] for r in got) == sorted(want.values()) and len(got) == 6
    plain = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string, extra int"), ngram_join.Jaccard(5, 80, 100))
    assert sorted((r.doc_id, r.component_id) for r in plain.collect()) == sorted(
        (k, want[int(t.split("-")[0])]) for k, t, _ in rows
    )


def test_the_least_id_there_is(spark):
    docs = spark.createDataFrame([(-(2**63), "a b", ""), (2**63 - 1, "a b", ""), (None, "ab", "")], DOCS)
    index = DigestIndex(spark, "digest_index_extremes", work_dir(spark, "digest-index"))
    assert {r.keep_id for r in index.add(docs, "one").collect()} == {-(2**63)}


@pytest.mark.parametrize("sampled", [1, 5, 10_000])
def test_frequent_pre_tokens_shuffle_nothing(spark, sampled):
    docs = spark.createDataFrame([(i, f"the the the word{i} of") for i in range(200)], "id long, text string")
    found = tokens.frequent_pre_tokens(docs, 2, sampled)
    assert len(found) <= 2 and (sampled < 10_000 or found[0] == "the")


def test_levels_reach_the_driver_as_bytes(spark, monkeypatch):
    """The driver got 8 bytes a slot and sorted them; now it gets one, and the same estimate from sums by level."""
    draw = random.Random(5)
    texts = [" ".join(f"w{int(draw.paretovariate(1)) % 500}" for _ in range(60)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rule = ngram_join.Jaccard(1, 80, 100)
    blocks = block_table(docs, "doc_id", "text")
    chosen = ngram_join._with_rows(blocks, ngram_join._stats(blocks, rule).select("rid"))
    got, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda df: got.extend(rows := collect(df)) or rows)
    levels, length = ngram_join._levels(chosen, rule)
    assert sum(len(v) for row in got for v in row if isinstance(v, (bytes, bytearray))) < 3 << 20
    counts = np.zeros(1 << ngram_join.SLOT_BITS, np.int64)
    for text in texts:
        for token in ngram_join.shingle_sets(text.encode(), [len(text.encode())], 1)[0]:
            counts[int(token) >> (64 - ngram_join.SLOT_BITS)] += 1
    assert (levels == np.round(8 * np.log2(1 + counts))).all()
    ranked = np.sort(counts)
    rare = ranked[: 1 + int(np.searchsorted(np.cumsum(ranked), 0.2 * ranked.sum()))].astype(float)
    assert length == pytest.approx((rare**2).sum() / rare.sum() - counts.mean(), rel=0.05)


def test_rounds_without_links_rank_nothing_again(spark, monkeypatch):
    draw = random.Random(8)
    pool = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(draw.sample(pool, 20))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "light_boundary", lambda *_: 0)
    rounds, ranked = [], []
    for name, calls in (("_verified", rounds), ("_unsettled", ranked)):
        monkeypatch.setattr(ngram_join, name, lambda *a, f=getattr(ngram_join, name), calls=calls: calls.append(1) or f(*a))
    found = ngram_join.ngram_components(docs, ngram_join.Jaccard(1, 80, 100)).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute.components(rows, 1, 80, 100)
    assert len(rounds) > 2 and len(ranked) == 1


@pytest.mark.parametrize("n", [0, 1, 2, 60])
def test_components_of_a_path(spark, n):
    nodes = list(range(n + 1))
    random.Random(1).shuffle(nodes)
    links = [(nodes[i], nodes[i + 1]) for i in range(n)]
    found = components(spark.createDataFrame([*links, (-5, -5)], "a long, b long"))
    assert sorted(tuple(r) for r in found.collect()) == [(i, 0) for i in range(n + 1) if n]
