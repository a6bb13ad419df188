"""Searches that skip files: never one that holds a match, most of those that do not."""

import random
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from logharrow import registry
from logharrow.filters import Filter
from logharrow.plans import reports, stored
from logharrow.schemas import CLF, conform
from logharrow.sources import commits, files, tables, textindex
from test_storage import NOW


@pytest.fixture(scope="module", autouse=True)
def filters_for_small_files():
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(textindex, "LEAST_BYTES", 0)
        yield


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory, filters_for_small_files):
    draw = random.Random(3)
    root = str(tmp_path_factory.mktemp("searched") / "tables")
    for batch in range(8):
        rows = [
            (f"/shop/{batch}/" + "".join(draw.choices("abcdefghij", k=9)), f"10.0.{batch}.{i}", f"Ä{batch}Öß naïve K{batch} {draw.random()}", NOW - timedelta(hours=batch))
            for i in range(60)
        ]
        df = spark.createDataFrame(rows, "path string, remote_host string, raw string, ts timestamp_ntz")
        tables.append_batch(conform(df.coalesce(1), CLF), f"{root}/apache", batch)
    return root


def chosen(spark, root, q):
    now = commits.latest(spark, root)
    flt = Filter(range="7d", q=q)
    return stored.files_for(spark, now, "apache", flt, NOW), stored.files_in_range(now, "apache", flt, NOW)


@pytest.mark.parametrize("q", ["/shop/3/", "SHOP/3", "10.0.5.", "0.7%1.3", "ä4öß", "NAÏVE", "k2", "/s_op/6", "%%", "a", "nothing like it", "\\", "x%yz"])
def test_no_match_is_lost(spark, root, q):
    some, every = chosen(spark, root, q)
    now, flt, spec = commits.latest(spark, root), Filter(range="7d", q=q), registry.get("apache").report
    want = flt.apply(tables.open_table(spark, root, "apache"), spec, NOW).select("raw", "path").collect()
    got = stored.rows_in_range(spark, "apache", flt, NOW, now).select("raw", "path").collect()
    assert sorted(got) == sorted(want)
    page = stored.stored_page(spark, "apache", Filter(range="7d", q=q, limit=10), NOW, now)
    whole = reports.raw_report(tables.open_table(spark, root, "apache"), Filter(range="7d", q=q, limit=10), NOW, spec)
    assert page.orderBy("pos").collect() == whole.orderBy("pos").collect()
    if q in ("/shop/3/", "10.0.5.", "/s_op/6", "nothing like it"):
        assert len(some) <= 2 < len(every)


def test_files_without_filters_are_read(spark, root):
    now = commits.latest(spark, root)
    bare = [(commits.Portion(p.table, p.day, p.batch, p.files, p.counts), f) for p in now.of("apache") for f in p.files]
    assert textindex.may_hold(spark, root, "apache", "nothing like it", bare) == bare


def test_small_files_have_no_filter(spark, tmp_path, monkeypatch):
    from test_storage import aged

    monkeypatch.setattr(textindex, "LEAST_BYTES", 1 << 18)
    tables.append_batch(aged(spark, (1, 1)), str(tmp_path / "t" / "apache"), 0)
    now = commits.latest(spark, str(tmp_path / "t"))
    assert not any(p.indexed for p in now.of("apache"))
    assert len(stored.files_for(spark, now, "apache", Filter(range="7d", q="nothing like it"), NOW)) == 1


def test_filters_go_with_their_files(spark, root):
    days = [textindex.commits.Portion.key.fget(p)[1] for p in commits.latest(spark, root).of("apache")]
    from logharrow.plans import maintain

    assert maintain.compact_table(spark, root, "apache", [maintain._day_of(d) for d in days], force=True)
    paths = {textindex.filters_path(p.counts).split("/")[-1] for p in commits.latest(spark, root).of("apache")}
    assert set(files.list_dirs(spark, f"{root}/_commits/filters")) == paths
    assert all(p.indexed for p in commits.latest(spark, root).of("apache"))


def test_trigrams():
    assert textindex.trigrams(b"ab").tolist() == [] and len(textindex.trigrams(b"abc\0def")) == 2
    assert len(textindex.pattern_trigrams("ab%cd_ef")) == 0 and len(textindex.pattern_trigrams("ABCD%é")) == 2
    bits = textindex.places(np.arange(1000, dtype=np.uint32))
    assert bits.min() >= 0 and bits.max() < textindex.BITS and len(np.unique(bits)) > 1900


def test_a_file_read_by_several_tasks(spark, root):
    """Stretches of a file have filters of their own; one that fits is enough."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        rows = spark.range(3000).select(F.concat(F.lit("/x/"), F.sha2(F.col("id").cast("string"), 256)).alias("path"), F.lit(NOW).cast("timestamp_ntz").alias("ts"))
        tables.append_batch(conform(rows.coalesce(1), CLF), f"{root}/nginx", 0)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    wanted = rows.where("id % 1000 = 7" if "id" in rows.columns else "true").first().path
    now = commits.latest(spark, root)
    found = stored.rows_in_range(spark, "nginx", Filter(range="7d", q=wanted), NOW, now)
    assert [r.path for r in found.collect()] == [wanted]


def test_texts_are_marked_as_they_lie(monkeypatch):
    """Bytes of a slice of an Arrow column, in chunks: all trigrams, those over the ends of chunks too, and no others."""
    import pyarrow as pa

    monkeypatch.setattr(textindex, "CHUNK_BYTES", 5)
    texts = pa.array(["before\0", "abc\0defgh\0", "\0", "naïve K7\0", "behind\0"]).slice(1, 3)
    bits = np.zeros(textindex.BITS, bool)
    textindex._mark(bits, texts)
    want = np.unique(textindex.places(textindex.trigrams("".join(texts.to_pylist()).encode())))
    assert len(want) > 8 and np.flatnonzero(bits).tolist() == want.tolist()


def test_marks_leave_the_table_of_trigrams_empty():
    """What one file held is in no filter of the next; no trigram spans a zero byte, whichever of its three it is."""
    import pyarrow as pa

    seen = np.zeros(1 << 24, bool)
    for text in ("abc\0", "ab\0cd\0", "\0\0xyz\0", "a\0", ""):
        bits = np.zeros(textindex.BITS, bool)
        textindex._mark(bits, pa.array([text]), seen)
        assert np.flatnonzero(bits).tolist() == np.unique(textindex.places(textindex.trigrams(text.encode()))).tolist()
        assert not seen.any()
