from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logharrow import registry
from logharrow.filters import Filter
from logharrow.operators import lookup
from logharrow.plans import maintain
from logharrow.schemas import CLF, RAW_ENVELOPE, SOURCES, conform
from logharrow.sources import dimensions, files, rewrites, tables
from logharrow.streaming import ingest, live
from test_parsers import ASA_DENY, COMBINED, PANOS, TRAEFIK

NOW = datetime(2026, 6, 30, 12, 0, 0)


def aged(spark, *ages):
    """Rows (days since the event or None, days since arrival)."""
    def back(days):
        return None if days is None else NOW - timedelta(days=days)

    rows = [(f"h{i}", back(event), back(arrival)) for i, (event, arrival) in enumerate(ages)]
    return conform(spark.createDataFrame(rows, "remote_host string, ts timestamp_ntz, received_at timestamp_ntz"), CLF)


AGES = ((1, 1), (10, 10), (40, 40), (None, 40), (None, 2))


@pytest.fixture
def root(spark, tmp_path):
    tables.init_tables(spark, str(tmp_path))
    return str(tmp_path)


def hosts(spark, root):
    return sorted(r.remote_host for r in tables.open_table(spark, root, "apache").collect())


def test_tables_start_empty(spark, root):
    for name in registry.names():
        assert tables.open_table(spark, root, name).count() == 0
    tables.init_tables(spark, root)


def test_prune(spark, root):
    tables.append_batch(aged(spark, *AGES), f"{root}/apache", 0)
    assert maintain.prune(spark, root, 0, NOW)["apache"] == 0
    assert maintain.prune(spark, root, 30, NOW)["apache"] == 2
    assert hosts(spark, root) == ["h0", "h1", "h4"]
    assert maintain.prune(spark, root, 7, NOW)["apache"] == 1
    assert hosts(spark, root) == ["h0", "h4"]
    assert maintain.prune(spark, root, 7, NOW)["apache"] == 0


def test_prune_cuts_within_a_day_and_keeps_the_edge(spark, root):
    edge = NOW - timedelta(days=5)
    rows = spark.createDataFrame(
        [("old", edge - timedelta(microseconds=1)), ("edge", edge), ("young", edge + timedelta(hours=1))],
        "remote_host string, ts timestamp_ntz",
    )
    tables.append_batch(conform(rows, CLF), f"{root}/apache", 0)
    assert maintain.prune_table(spark, root, "apache", 5, NOW) == 1
    assert hosts(spark, root) == ["edge", "young"]


def test_batch_is_stored_once(spark, root):
    for _ in range(3):
        tables.append_batch(aged(spark, *AGES), f"{root}/apache", 4)
    tables.append_batch(aged(spark, (1, 1)), f"{root}/apache", 5)
    assert len(hosts(spark, root)) == 6


def test_compaction(spark, root):
    for batch in range(3):
        tables.append_batch(aged(spark, (1, 1), (2, 2)).repartition(2), f"{root}/apache", batch)
    day = (NOW - timedelta(days=1)).date()
    before = tables.open_table(spark, root, "apache").drop("ingest_batch").orderBy("remote_host").collect()
    assert not maintain.compact_table(spark, root, "apache", [day])  # few files
    assert maintain.compact_table(spark, root, "apache", [day], force=True) == 1
    assert len(files.data_files(spark, f"{root}/apache/event_date={day}")) == 1
    assert tables.open_table(spark, root, "apache").drop("ingest_batch").orderBy("remote_host").collect() == before
    assert not maintain.compact_table(spark, root, "apache", [date(2001, 1, 1)], force=True)


def test_when_compaction_is_worth_it():
    mb = 1024 * 1024
    assert maintain.needs_compaction([1000] * 9)  # many tiny files, however small the day
    assert not maintain.needs_compaction([1000] * 8)
    assert not maintain.needs_compaction([1000])
    assert not maintain.needs_compaction([300 * mb, 300 * mb])
    assert maintain.needs_compaction([250 * mb] * 2 + [1 * mb] * 2)


def test_compact_and_maintain_fire_on_many_small_files(spark, root):
    for batch in range(12):
        tables.append_batch(aged(spark, (1, 1), (40, 40)), f"{root}/apache", batch)
    done = maintain.run(spark, root, 30, NOW)
    assert done["pruned"]["apache"] == 12 and done["compacted"]["apache"] == 1
    assert hosts(spark, root) == ["h0"] * 12


def late(spark, root, batch):
    tables.append_batch(aged(spark, (5, 5)), f"{root}/apache", batch)


def interrupt(monkeypatch, step, then):
    """Run ``then`` right after a step of a rewrite."""
    real = getattr(rewrites, step)

    def wrapped(*args):
        result = real(*args)
        then()
        return result

    monkeypatch.setattr(rewrites, step, wrapped)


@pytest.mark.parametrize("work", ["prune", "compact"])
def test_rows_that_come_in_during_a_rewrite_stay(spark, root, monkeypatch, work):
    day = (NOW - timedelta(days=5)).date()
    tables.append_batch(aged(spark, (5, 5)), f"{root}/apache", "first-0")
    old = aged(spark, (5, 5)).withColumn("ts", F.col("ts") - F.expr("INTERVAL 1 HOUR"))
    tables.append_batch(old, f"{root}/apache", "first-1")
    interrupt(monkeypatch, "begin", lambda: late(spark, root, "second-0"))
    if work == "prune":
        assert maintain.prune_table(spark, root, "apache", 5, NOW) == 1
        assert len(hosts(spark, root)) == 2
    else:
        assert maintain.compact_table(spark, root, "apache", [day], force=True) == 1
        assert len(hosts(spark, root)) == 3


@pytest.mark.parametrize("step", ["begin", "commit"])
def test_a_rewrite_cut_short_loses_and_doubles_nothing(spark, root, monkeypatch, step):
    for batch in range(3):
        late(spark, root, batch)
    day = (NOW - timedelta(days=5)).date()
    real = files.remove

    def crash(*_):
        raise OSError("stopped")

    with monkeypatch.context() as broken:
        if step == "begin":
            broken.setattr(rewrites, "commit", crash)  # written, not committed
        else:
            broken.setattr(files, "remove", crash)  # committed, not cleaned up
        with pytest.raises(OSError):
            maintain.compact_table(spark, root, "apache", [day], force=True)
    assert files.remove is real
    assert len(hosts(spark, root)) == 3
    rewrites.recover(spark, f"{root}/apache")
    assert len(hosts(spark, root)) == 3 and not rewrites.open_rewrites(spark, f"{root}/apache")


def test_rows_without_time_survive_a_rewrite(spark, root):
    tables.append_batch(aged(spark, (None, None), (5, 5)), f"{root}/apache", 0)
    path = f"{root}/apache"
    rewrite = rewrites.begin(spark, path, [("event_date=__HIVE_DEFAULT_PARTITION__", "ingest_batch=0")])
    files.write_text(spark, f"{path}/_rewrites/{rewrite.batch}.done", "[[\"event_date=__HIVE_DEFAULT_PARTITION__\", \"ingest_batch=0\"]]")
    assert hosts(spark, root) == ["h1"]


def test_streams_of_two_checkpoints_keep_their_batches(spark, root):
    for stream in ("one", "two"):
        tables.append_batch(aged(spark, (1, 1)), f"{root}/apache", tables.stream_batch(stream, 0))
    assert len(hosts(spark, root)) == 2


def test_retry_under_an_edited_sender_table_moves_the_rows(spark, root):
    messages = spark.createDataFrame([("10.0.0.1", COMBINED, NOW), ("10.9.9.9", COMBINED, NOW), ("10.0.0.1", "junk", NOW)], RAW_ENVELOPE)
    for log_type in ("apache", "nginx"):
        sources = spark.createDataFrame([("10.0.0.1", "w", log_type, NOW)], SOURCES)
        ingest.store_batch(messages, 7, root, sources, None, "s")
    assert tables.open_table(spark, root, "apache").count() == 0
    assert tables.open_table(spark, root, "nginx").count() == 1
    got = ingest.ingest_stats(spark, root).collect()
    assert [tuple(r)[1:] for r in got] == [(3, 1, 1, 1)]


def test_senders_are_there_during_a_save(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "senders")
    one = spark.createDataFrame([("10.0.0.1", "w", "apache", NOW)], SOURCES)
    dimensions.save_sources(spark, one, path)
    held = dimensions.load_sources(spark, path)
    spark.createDataFrame([], SOURCES).write.parquet(f"{path}/v1/_unfinished")  # a save cut short
    assert dimensions.load_sources(spark, path).count() == 1
    dimensions.save_sources(spark, one.union(one.withColumn("ip", F.lit("10.0.0.2"))), path)
    assert dimensions.load_sources(spark, path).count() == 2 and held.count() == 1


def test_a_sender_listed_twice(spark, tmp_path):
    empty = spark.createDataFrame([], SOURCES)
    twice = changes(spark, ("10.0.0.1", "b", "apache"), ("10.0.0.1", "a", "nginx"))
    got = dimensions.upsert_sources(empty, twice, NOW).collect()
    assert [(r.ip, r.name, r.log_type) for r in got] == [("10.0.0.1", "a", "nginx")]
    rows = spark.createDataFrame([("10.0.0.1", "w", "apache", NOW), ("10.0.0.1", "x", "nginx", NOW)], SOURCES)
    with pytest.raises(Exception, match="sender listed twice"):
        dimensions.save_sources(spark, rows, str(tmp_path / "s"))


@pytest.mark.parametrize("mode", ["complete", "append"])
def test_live_tables_keep_earlier_results(spark, tmp_path, mode):
    inbox, path = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "k string, ts timestamp"
    spark.createDataFrame([], schema).write.parquet(inbox)
    rows = spark.readStream.schema(schema).parquet(inbox)
    frame = rows.groupBy("k").count() if mode == "complete" else rows.select("k")
    assert live.read_table(spark, path, frame.schema).count() == 0
    for key in ("a", "b"):
        spark.createDataFrame([(key, NOW)], schema).coalesce(1).write.mode("append").parquet(inbox)
        live.start_table(frame, path, str(tmp_path / "checkpoint"), mode, {"availableNow": True}).awaitTermination()
    assert sorted(r.k for r in live.read_table(spark, path, frame.schema).collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        live.start_table(frame, path, str(tmp_path / "checkpoint"), "update")


def test_streams_are_not_looked_up_by_shuffle(spark, tmp_path):
    rows = spark.readStream.schema("k string").parquet(str(tmp_path))
    with pytest.raises(ValueError):
        lookup.lookup_join(rows, spark.createDataFrame([("a", 1)], "k string, v int"), "k", broadcast=False)


def test_range_prunes_day_folders(spark, root):
    tables.append_batch(aged(spark, *AGES), f"{root}/apache", 0)
    df = Filter(range="7d").apply(tables.open_table(spark, root, "apache"), registry.get("apache").report, NOW)
    plan = df._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters:")[1].split("]")[0]
    assert "event_date" in filters and "2026-06-23" in filters
    assert "PushedFilters" in plan and "GreaterThanOrEqual(ts" in plan
    assert [r.remote_host for r in df.collect()] == ["h0"]


def test_old_files_gain_new_columns(spark, root):
    old = aged(spark, (1, 1)).drop("country", "country_code")
    old.withColumns({"event_date": F.to_date("ts"), "ingest_batch": F.lit("0")}).write.mode(
        "overwrite").partitionBy("event_date", "ingest_batch").parquet(f"{root}/apache")
    tables.append_batch(aged(spark, (2, 2)), f"{root}/apache", 1)
    assert {r.country for r in tables.open_table(spark, root, "apache").collect()} == {None}


def changes(spark, *rows):
    return spark.createDataFrame(rows, "ip string, name string, log_type string")


def test_sources(spark, tmp_path):
    path = str(tmp_path / "sources")
    assert dimensions.load_sources(spark, path).count() == 0
    first = dimensions.upsert_sources(
        dimensions.load_sources(spark, path), changes(spark, (" 10.0.0.1 ", " web ", "apache"), ("::1", "fw", "panos")), NOW)
    dimensions.save_sources(spark, first, path)
    later = NOW + timedelta(days=1)
    second = dimensions.upsert_sources(
        dimensions.load_sources(spark, path), changes(spark, ("10.0.0.1", "renamed", "nginx"), ("10.0.0.3", "b", "caddy")), later)
    dimensions.save_sources(spark, second, path)
    got = [tuple(r) for r in dimensions.list_sources(dimensions.load_sources(spark, path)).collect()]
    assert got == [("10.0.0.3", "b", "caddy", later), ("::1", "fw", "panos", NOW), ("10.0.0.1", "renamed", "nginx", NOW)]
    assert dimensions.delete_source(dimensions.load_sources(spark, path), " ::1 ").count() == 2
    bad = changes(spark, ("x", "n", "apache"), ("1.1.1.1", "  ", "apache"), ("1.1.1.1", "n", "smtp"), ("1.1.1.1", "n", "apache"))
    assert sorted(r.problem for r in dimensions.rejected_sources(bad).collect()) == [
        "name is required", "not a valid IP address", "unknown log type"]


def test_geo_table_is_optional(spark, tmp_path):
    assert dimensions.load_geo_ranges(spark, "", str(tmp_path / "none")) is None
    spark.createDataFrame([("8.8.8.0", "8.8.8.255", "US", "United States")], "lo string, hi string, country_code string, country string").write.parquet(str(tmp_path / "geo"))
    assert dimensions.load_geo_ranges(spark, str(tmp_path / "none"), str(tmp_path / "geo")).broadcast


def test_stream_equals_batch_and_sees_edits(spark, root, tmp_path):
    lines = [
        ("10.0.0.1", COMBINED), ("10.0.0.1", f"<13>Aug 16 10:00:00 web httpd: {COMBINED}"), ("10.0.0.2", f"<13>{ASA_DENY}"),
        ("10.0.0.3", PANOS), ("10.0.0.4", TRAEFIK), ("10.0.0.4", "garbage"), ("10.9.9.9", COMBINED),
    ]
    inbox, senders = str(tmp_path / "in"), str(tmp_path / "senders")
    spark.createDataFrame([(ip, line, NOW) for ip, line in lines], RAW_ENVELOPE).write.parquet(inbox)
    known = [("10.0.0.1", "w", "apache", NOW), ("10.0.0.2", "a", "cisco_asa", NOW), ("10.0.0.3", "p", "panos", NOW),
             ("10.0.0.4", "t", "traefik", NOW)]
    dimensions.save_sources(spark, spark.createDataFrame(known, SOURCES), senders)

    def run():
        stream = ingest.start_ingest(
            spark.readStream.schema(RAW_ENVELOPE).parquet(inbox), root, str(tmp_path / "checkpoint"),
            lambda session: dimensions.load_sources(session, senders), None, {"availableNow": True})
        stream.awaitTermination()

    def stored():
        return {n: tables.open_table(spark, root, n).count() for n in registry.names()}

    run()
    once = {"apache": 2, "caddy": 0, "cisco_asa": 1, "haproxy": 0, "nginx": 0, "panos": 1, "traefik": 1}
    assert stored() == once
    run()  # nothing new
    assert stored() == once
    batch = tables.to_events(
        spark.createDataFrame([("10.0.0.1", None, None, COMBINED, NOW)], "source_ip string, hostname string, tag string, raw string, received_at timestamp_ntz"),
        "apache", None)
    streamed = tables.open_table(spark, root, "apache").drop("event_date", "ingest_batch")
    assert {tuple(r) for r in streamed.collect()} == {tuple(r) for r in batch.collect()}
    # A sender added between batches takes effect with the next one.
    edited = dimensions.upsert_sources(dimensions.load_sources(spark, senders), changes(spark, ("10.9.9.9", "new", "nginx")), NOW)
    dimensions.save_sources(spark, edited, senders)
    spark.createDataFrame([("10.9.9.9", COMBINED, NOW)], RAW_ENVELOPE).write.mode("append").parquet(inbox)
    run()
    assert stored() == {**once, "nginx": 1}


def test_outcomes(spark):
    sources = spark.createDataFrame([("10.0.0.1", "w", "apache", NOW), ("10.0.0.4", "t", "traefik", NOW)], SOURCES)
    rows = [("10.0.0.1", COMBINED), ("10.0.0.1", TRAEFIK), ("10.0.0.4", TRAEFIK), ("10.9.9.9", COMBINED)]
    messages = spark.createDataFrame([(ip, line, NOW) for ip, line in rows], RAW_ENVELOPE)
    got = sorted((r.log_type or "", r.parsed) for r in ingest.outcomes(messages, sources).collect())
    assert got == [("", False), ("apache", False), ("apache", True), ("traefik", True)]
