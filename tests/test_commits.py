"""The log of commits: versions, pins, batches over all tables, and reports that follow from it."""

import json
import time
from concurrent.futures import ThreadPoolExecutor
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from logharrow import registry
from logharrow.filters import Filter
from logharrow.operators import kpis, overview, raw
from logharrow.plans import maintain, reports, stored
from logharrow.schemas import CLF, RAW_ENVELOPE, SOURCES, conform
from logharrow.sources import commits, dimensions, files, leases, tables
from logharrow.streaming import ingest
from test_parsers import ASA_DENY, COMBINED, PANOS, TRAEFIK
from test_storage import AGES, NOW, aged, hosts

KNOWN = [("10.0.0.1", "w", "apache", NOW), ("10.0.0.2", "a", "cisco_asa", NOW), ("10.0.0.3", "p", "panos", NOW), ("10.0.0.4", "t", "traefik", NOW)]


@pytest.fixture
def root(spark, tmp_path):
    return str(tmp_path / "tables")


def stored_rows(spark, root):
    return {n: tables.open_table(spark, root, n).count() for n in registry.names()}


def test_commits_of_many_writers_are_all_kept(spark, root):
    def write(i):
        portion = commits.Portion("apache", f"event_date=2026-01-{i + 1:02d}", f"ingest_batch={i}", (commits.File("f", 1),))
        commits.commit(spark, root, [portion], tables=["apache"])

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(write, range(20)))
    assert len(commits.latest(spark, root).of("apache")) == 20 and commits.latest(spark, root).number == 20


def test_state_is_written_now_and_then_and_read_afresh(spark, root, monkeypatch):
    monkeypatch.setattr(commits, "STATE_EVERY", 4)
    for i in range(11):
        portion = commits.Portion("apache", "event_date=2026-01-01", f"ingest_batch={i}", (commits.File("f", i),))
        commits.commit(spark, root, [portion], [("apache", "event_date=2026-01-01", f"ingest_batch={i - 1}")] if i else [], tables=["apache"])
    held = commits.latest(spark, root)
    commits.sweep(spark, root)
    names = files.list_files(spark, f"{root}/_commits")
    assert "000000000008.state" in names and "000000000003.json" not in names
    monkeypatch.setattr(commits, "_KNOWN", {})
    again = commits.latest(spark, root)
    assert again.live == held.live and again.tables == {"apache"} and not again.dropped


def test_a_commit_cut_short_is_passed_over(spark, root, monkeypatch):
    monkeypatch.setattr(commits, "PATIENCE", 0.2)
    tables.append_batch(aged(spark, *AGES), f"{root}/apache", 0)
    number = commits.latest(spark, root).number
    files.write_text(spark, f"{root}/_commits/{number + 1:012d}.json", '{"add": [')
    assert len(hosts(spark, root)) == 5
    tables.append_batch(aged(spark, (1, 1)), f"{root}/apache", 1)
    assert len(hosts(spark, root)) == 6 and commits.latest(spark, root).number == number + 2


def test_what_is_dropped_twice_is_refused(spark, root):
    tables.append_batch(aged(spark, (1, 1)), f"{root}/apache", 0)
    key = commits.latest(spark, root).of("apache")[0].key
    commits.commit(spark, root, drop=[key])
    with pytest.raises(commits.Superseded):
        commits.commit(spark, root, drop=[key])


@pytest.mark.parametrize("work", ["prune", "compact", "again"])
def test_a_pinned_reader_keeps_its_rows(spark, root, work):
    for batch in range(3):
        tables.append_batch(aged(spark, *AGES), f"{root}/apache", batch)
    with commits.pinned(spark, root) as then:
        held = tables.open_table(spark, root, "apache", then)
        if work == "prune":
            assert maintain.prune_table(spark, root, "apache", 7, NOW) == 9
        elif work == "compact":
            day = (NOW - timedelta(days=1)).date()
            assert maintain.compact_table(spark, root, "apache", [day], force=True) == 1
        else:
            tables.append_batch(aged(spark, (1, 1)), f"{root}/apache", 2)
        commits.sweep(spark, root)
        assert held.count() == 15 and held.select("raw", "ts").collect()
        assert commits.latest(spark, root).dropped
    commits.sweep(spark, root)
    assert not commits.latest(spark, root).dropped
    assert len(hosts(spark, root)) == {"prune": 6, "compact": 15, "again": 11}[work]
    used = {f"{p.folder}" for p in commits.latest(spark, root).of("apache")}
    days = [d for d in files.list_dirs(spark, f"{root}/apache") if d.startswith("event_date")]
    assert {f"apache/{d}/{b}" for d in days for b in files.list_dirs(spark, f"{root}/apache/{d}")} == used


def test_keep_seconds_and_lost_pins(spark, root, monkeypatch):
    tables.append_batch(aged(spark, *AGES), f"{root}/apache", 0)
    assert maintain.prune_table(spark, root, "apache", 7, NOW, keep_seconds=3600) == 3
    assert commits.latest(spark, root).dropped and not commits.sweep(spark, root, 3600)
    files.write_text(spark, f"{root}/_commits/pins/{1:012d}-lost", str(time.time() - 2 * commits.PIN_SECONDS))
    assert commits.sweep(spark, root) and not commits.latest(spark, root).dropped


def test_of_two_compactions_one_counts(spark, root, monkeypatch):
    for batch in range(3):
        tables.append_batch(aged(spark, (1, 1)), f"{root}/apache", batch)
    day = (NOW - timedelta(days=1)).date()
    real = maintain.rewrites.begin

    def second_first(*args):
        monkeypatch.setattr(maintain.rewrites, "begin", real)
        mine = real(*args)
        other = maintain.read_portions(spark, root, "apache", commits.latest(spark, root).of("apache"))
        assert maintain._replace(spark, f"{root}/apache", commits.latest(spark, root).of("apache"), other)
        commits.sweep(spark, root)
        return mine

    monkeypatch.setattr(maintain.rewrites, "begin", second_first)
    assert maintain.compact_table(spark, root, "apache", [day], force=True) == 0
    assert hosts(spark, root) == ["h0"] * 3
    assert len(files.data_files(spark, f"{root}/apache")) == sum(len(p.files) for p in commits.latest(spark, root).of("apache"))


def test_a_table_filled_without_a_log_is_taken_up(spark, root):
    old = aged(spark, (1, 1), (None, None)).withColumns({"event_date": F.to_date("ts"), "ingest_batch": F.lit("old")})
    old.write.partitionBy("event_date", "ingest_batch").parquet(f"{root}/apache")
    assert hosts(spark, root) == ["h0", "h1"]
    tables.append_batch(aged(spark, (2, 2)), f"{root}/apache", 1)
    assert hosts(spark, root) == ["h0", "h0", "h1"]
    assert maintain.prune_table(spark, root, "apache", 1, NOW - timedelta(seconds=1)) == 1  # without any time nothing ages
    assert hosts(spark, root) == ["h0", "h1"]


def test_files_are_described(spark, root):
    tables.append_batch(aged(spark, (1, 3), (None, 2), (None, None)).coalesce(1), f"{root}/apache", 0)
    found = {p.day: f for p in commits.latest(spark, root).of("apache") for f in p.files}
    micros = lambda days: stored.micros(NOW - timedelta(days=days))
    day = lambda days: f"event_date={(NOW - timedelta(days=days)).date()}"
    timed, arrived, bare = found[day(1)], found[day(2)], found["event_date=__HIVE_DEFAULT_PARTITION__"]
    assert (timed.rows, timed.timed, timed.low, timed.high, timed.oldest, timed.arrived) == (1, 1, micros(1), micros(1), micros(1), micros(3))
    assert (arrived.timed, arrived.low, arrived.aged, arrived.youngest) == (0, None, 1, micros(2))
    assert (bare.rows, bare.aged, bare.oldest, bare.arrived) == (1, 0, None, None)
    sizes = {name: size for p in commits.latest(spark, root).of("apache") for name, size in files.data_file_sizes(spark, f"{root}/{p.folder}")}
    assert {f.name: f.bytes for f in found.values()} == sizes


# Batches over all tables.


def messages(spark, *lines):
    return spark.createDataFrame([(ip, line, NOW) for ip, line in lines], RAW_ENVELOPE)


LINES = [("10.0.0.1", COMBINED), ("10.0.0.2", f"<13>{ASA_DENY}"), ("10.0.0.3", PANOS), ("10.0.0.4", TRAEFIK), ("10.0.0.4", "junk"), ("10.9.9.9", "x")]


@pytest.mark.parametrize("dies_at", [1, 3, 5, "commit"])
def test_a_batch_shows_in_all_tables_or_in_none(spark, root, monkeypatch, dies_at):
    known = spark.createDataFrame(KNOWN, SOURCES)
    real, left = ingest.write_attempt, [dies_at]

    def dying(*args):
        if left[0] != "commit":
            left[0] -= 1
            if left[0] == 0:
                raise OSError("the driver died")
        return real(*args)

    with monkeypatch.context() as broken:
        broken.setattr(ingest, "write_attempt", dying)
        if dies_at == "commit":
            broken.setattr(ingest, "commit_batch", lambda *a: (_ for _ in ()).throw(OSError("the driver died")))
        with pytest.raises(OSError):
            ingest.store_batch(messages(spark, *LINES), 0, root, known, None, "s")
    assert not any(p for p in commits.latest(spark, root).live)
    assert ingest.ingest_stats(spark, root).count() == 0
    for _ in range(2):
        ingest.store_batch(messages(spark, *LINES), 0, root, known, None, "s")
        assert stored_rows(spark, root) == {"apache": 1, "caddy": 0, "cisco_asa": 1, "haproxy": 0, "nginx": 0, "panos": 1, "traefik": 1}
        assert [tuple(r)[1:] for r in ingest.ingest_stats(spark, root).collect()] == [(6, 4, 1, 1)]


def test_a_batch_that_was_merged_is_not_stored_again(spark, root):
    known = spark.createDataFrame(KNOWN, SOURCES)
    for number in range(2):
        ingest.store_batch(messages(spark, *LINES), number, root, known, None, "s")
    before = stored_rows(spark, root)
    days = [maintain._day_of(p.day) for p in commits.latest(spark, root).of("apache")]
    assert maintain.compact_table(spark, root, "apache", days, force=True)
    for number in (1, 0):
        ingest.store_batch(messages(spark, *LINES), number, root, known, None, "s")
    assert stored_rows(spark, root) == before


# Reports that follow the log.


def spread(spark, root, batches=6):
    """Rows of several days and hours in several batches, some without a time."""
    for batch in range(batches):
        ids = spark.range(batch * 40, batch * 40 + 40)
        rows = ids.select(
            F.concat(F.lit("10.0.0."), (F.col("id") % 5).cast("string")).alias("source_ip"),
            F.when(F.col("id") % 11 > 0, F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(mins=(F.col("id") * 37).cast("int"))).alias("ts"),
            (F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(mins=(F.col("id") * 31).cast("int"))).alias("received_at"),
            F.concat(F.lit("line "), (F.col("id") % 90).cast("string")).alias("raw"),
            F.when(F.col("id") % 3 == 0, F.lit("DE")).alias("country_code"), F.when(F.col("id") % 3 == 0, F.lit("Germany")).alias("country"),
            (F.col("id") % 400).cast("int").alias("status"),
        )
        tables.append_batch(conform(rows.coalesce(2), CLF), f"{root}/apache", batch)


def test_pages_from_the_newest_files(spark, root):
    spread(spark, root)
    now, spec = commits.latest(spark, root), registry.get("apache").report
    everything = sum(len(p.files) for p in now.of("apache"))
    for flt in (Filter(range="7d", limit=7), Filter(range="30d", limit=50, q="line 3"), Filter(range="24h", limit=500), Filter(range="1h", country="Nowhere")):
        df = tables.open_table(spark, root, "apache")
        whole = reports.raw_report(df, flt, NOW, spec)
        page = stored.stored_page(spark, "apache", flt, NOW, now)
        assert page.orderBy("pos").collect() == whole.orderBy("pos").collect()
        last = page.orderBy(F.desc("pos")).select("key.*").first()
        if last:
            after = raw.Cursor(**last.asDict())
            following = stored.stored_page(spark, "apache", flt, NOW, now, after=after)
            assert following.orderBy("pos").collect() == reports.raw_report(df, flt, NOW, spec, after=after).orderBy("pos").collect()
    short = stored.stored_page(spark, "apache", Filter(range="30d", limit=3), NOW, now)
    assert short.count() == 3 and len(short.inputFiles()) <= 4 < everything


def test_recent_from_the_files_that_came_last(spark, root):
    spread(spark, root)
    now = commits.latest(spark, root)
    for n in (1, 5, 50, 1000):
        want = raw.recent(tables.open_table(spark, root, "apache"), n).collect()
        assert stored.stored_recent(spark, "apache", now, n).collect() == want
    assert len(stored.stored_recent(spark, "apache", now, 3).inputFiles()) < sum(len(p.files) for p in now.of("apache"))


@pytest.mark.parametrize("minutes", [0, 17, 61])
def test_overview_from_counts(spark, root, minutes):
    spread(spark, root)
    as_of = (NOW - timedelta(minutes=minutes)).replace(microsecond=5)
    assert maintain.prune_table(spark, root, "apache", 4, NOW) > 0
    tables.append_batch(aged(spark, *AGES), f"{root}/apache", 3)  # in the place of an earlier batch
    now = commits.latest(spark, root)
    maintain.compact_table(spark, root, "apache", [maintain._day_of(p.day) for p in now.of("apache")][:2], force=True)
    tables.append_batch(aged(spark, (1, 1)), f"{root}/nginx", 0)
    now = commits.latest(spark, root)
    base = stored.stored_base(spark, now, as_of)
    rows = overview.union_types({n: tables.open_table(spark, root, n) for n in ("apache", "nginx")})
    order = ["log_type", "source_ip", "country", "code"]
    assert base.orderBy(order).collect() == overview.overview_base(rows, as_of).orderBy(order).collect()
    events = [f for f in base.inputFiles() if "/_commits/" not in f]
    assert not events if minutes == 0 else len(events) < sum(len(p.files) for p in now.of("apache"))
    report = stored.stored_overview(spark, spark.createDataFrame(KNOWN, SOURCES), as_of, now)
    assert report["totals"].first().total == rows.count()
    report.release()


@pytest.mark.parametrize("minutes", [0, 17])
def test_counters_from_states(spark, root, minutes):
    spread(spark, root)
    as_of = (NOW - timedelta(minutes=minutes)).replace(microsecond=0)
    assert maintain.prune_table(spark, root, "apache", 4, NOW) > 0
    tables.append_batch(aged(spark, *AGES), f"{root}/apache", 3)  # in the place of an earlier batch
    now, spec = commits.latest(spark, root), registry.get("apache").report
    maintain.compact_table(spark, root, "apache", [maintain._day_of(p.day) for p in now.of("apache")][:2], force=True)
    now = commits.latest(spark, root)
    for range_ in ("1h", "24h", "7d", "1y"):
        got = stored.stored_kpis(spark, "apache", range_, as_of, now)
        rows = Filter(range=range_).apply(tables.open_table(spark, root, "apache"), spec, as_of)
        assert got.first() == kpis.web_kpis(rows).first()  # so few clients are counted exactly
        if minutes == 0:
            assert not [f for f in got.inputFiles() if "/_commits/" not in f]
    none = stored.stored_kpis(spark, "traefik", "1y", as_of, now).first()
    assert (none.requests, none.unique_ips, none.countries, none.avg_ms, none.p95_ms) == (0, 0, 0, None, None)


def test_size_on_disk(spark, tmp_path):
    """The size is that of all files under the root, log included, to the byte."""
    root = str(tmp_path / "sized")
    for name, n in (("apache/a.parquet", 1000), ("apache/d=1/b.parquet", 23), ("_commits/1.json", 7)):
        path = tmp_path / "sized" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * n)
    assert files.size_on_disk(spark, root) == 1030 and files.size_on_disk(spark, f"{root}/none") == 0
    assert files.table_size(spark, f"{root}/apache").collect() == [(1023,)]
    report = reports.overview_report({"apache": aged(spark, (1, 1))}, spark.createDataFrame(KNOWN, SOURCES), NOW, root)
    assert report["storage"].collect() == [(1030,)]
    report.release()


# Maintenance as a job.


def test_one_maintenance_run_at_a_time(spark, root, monkeypatch):
    tables.append_batch(aged(spark, *AGES), f"{root}/apache", 0)
    with leases.held(spark, root, "maintenance") as number:
        with pytest.raises(leases.Busy):
            maintain.run(spark, root, 7, NOW)
        assert len(hosts(spark, root)) == 5 and leases.still_holds(spark, root, "maintenance", number)
    done = maintain.run(spark, root, 7, NOW)
    assert done["pruned"]["apache"] == 3


def test_a_lease_that_ran_out_is_taken_over(spark, root):
    files.write_text(spark, f"{root}/_leases/maintenance/{3:012d}", json.dumps({"until": time.time() - 1}))
    with leases.held(spark, root, "maintenance") as number:
        assert number == 4 and not leases.still_holds(spark, root, "maintenance", 3)
    with leases.held(spark, root, "maintenance") as number:
        assert number == 5


def test_of_many_runners_one_gets_the_lease(spark, root):
    def take(_):
        try:
            with leases.held(spark, root, "x"):
                time.sleep(0.5)
                return 1
        except leases.Busy:
            return 0

    with ThreadPoolExecutor(6) as pool:
        assert sum(pool.map(take, range(6))) == 1


def test_regular_maintenance(spark, root, tmp_path):
    tables.append_batch(aged(spark, *AGES), f"{root}/apache", 0)
    job = maintain.start_regular(
        spark, root, 7, str(tmp_path / "checkpoint"), clock=lambda: NOW, every="2 seconds", first_after="1 second", keep_seconds=0.0
    )
    try:
        end = time.monotonic() + 60
        while len(hosts(spark, root)) != 2 and time.monotonic() < end and job.isActive:
            time.sleep(0.5)
    finally:
        job.stop()
    assert hosts(spark, root) == ["h0", "h4"]


# Edits of the sender table.


def test_editors_at_once_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "senders")
    dimensions.save_sources(spark, spark.createDataFrame(KNOWN, SOURCES), path)

    def edit(i):
        new = spark.createDataFrame([(f"10.1.0.{i}", f"n{i}", "apache")], "ip string, name string, log_type string")
        return dimensions.edit_sources(spark, path, lambda rows: dimensions.upsert_sources(rows, new, NOW), tries=50)

    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(edit, range(6)))
    assert sorted(numbers) == list(range(2, 8)) and dimensions.load_sources(spark, path).count() == len(KNOWN) + 6
    with pytest.raises(dimensions.EditConflict):
        dimensions.save_sources(spark, spark.createDataFrame([], SOURCES), path, based_on=3)
    for _ in range(6):
        dimensions.edit_sources(spark, path, lambda rows: rows)
    assert len([d for d in files.list_dirs(spark, path) if d.startswith("s-")]) == dimensions.KEPT + 2


def test_senders_saved_before_versions_had_heads(spark, tmp_path):
    path = str(tmp_path / "senders")
    files.write_version(spark, spark.createDataFrame(KNOWN, SOURCES), path)
    assert dimensions.load_sources(spark, path).count() == len(KNOWN)
    assert dimensions.edit_sources(spark, path, lambda rows: dimensions.delete_source(rows, "10.0.0.1")) == 1
    assert dimensions.load_sources(spark, path).count() == len(KNOWN) - 1


def test_one_part_is_parsed_by_all_cores(spark, tmp_path, monkeypatch):
    """A batch that comes in one part, as of a file of one row group, keeps more than one task at work."""
    known = spark.createDataFrame([("192.0.2.1", "apache")], "ip string, log_type string")
    many, parts = spark.range(0, 400, 1, 1).crossJoin(messages(spark, *LINES).limit(1)).drop("id").coalesce(1), []
    real = ingest.parse_envelope
    monkeypatch.setattr(ingest, "parse_envelope", lambda df: parts.append(df.rdd.getNumPartitions()) or real(df))
    ingest.store_batch(many, 0, str(tmp_path), known, None, "s")
    assert parts == [spark.sparkContext.defaultParallelism]
    assert ingest.ingest_stats(spark, str(tmp_path)).agg(F.sum("received")).first()[0] == 400


# Many events at once.


def test_a_batch_of_several_tables_is_one_commit(spark, root):
    rows = {"apache": aged(spark, *AGES), "nginx": aged(spark, (1, 1), (2, 2))}
    for _ in range(2):  # the second time in the place of the first
        for name in rows:
            commits.adopt(spark, root, name, commits.listed)
        before = commits.latest(spark, root).number
        tables.append_batches(rows, root, "given-0")
        now = commits.latest(spark, root)
        assert now.number == before + 1 and len({p.batch for p in now.live.values()}) == 1
        assert hosts(spark, root) == sorted(r.remote_host for r in rows["apache"].collect())
        assert tables.open_table(spark, root, "nginx").count() == 2
        assert len({p.counts for p in now.live.values()}) == 1


def test_overview_of_scattered_events_has_few_files(spark, tmp_path, monkeypatch):
    """Files that each hold all days: a stream stores a day of a table in few files, however many tasks read them, so none needs compaction."""
    from workload import dashboards
    from workload.catalog import QUERIES

    given, seen = "/root/testdata/sf0.001", {}
    events = spark.read.parquet(f"{given}/events.parquet")
    events.repartition(12).write.parquet(str(tmp_path / "events.parquet"))
    spark.read.parquet(f"{given}/supplier.parquet").write.parquet(str(tmp_path / "supplier.parquet"))
    real = maintain.run

    def run(spark, root, *args):
        seen["before"] = commits.latest(spark, root)
        done = real(spark, root, *args)
        seen.update(done)
        return done

    monkeypatch.setattr(dashboards.maintain, "run", run)
    # One task for each file, as many files a day as tasks where nothing puts the events in order.
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")
    try:
        got = QUERIES["report_overview_stored"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(got) == sorted(QUERIES["report_overview_stored"](spark, given).collect())
    days = events.select(F.to_date("ts")).distinct().count()
    for name in dashboards._TABLES:
        portions = seen["before"].of(name)
        assert {tables.batch_of(p.batch) for p in portions} == {"stream0-0", "stream1-0"}
        assert sum(p.rows for p in portions) == events.count()
        # At most one file more than days for each of the eight ranges of time, in two streams.
        assert sum(len(p.files) for p in portions) <= 2 * (days + 2 * spark.sparkContext.defaultParallelism + 1)
    assert set(seen["compacted"].values()) == {0}
