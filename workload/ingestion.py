"""Parsing, routing, enrichment, storage, retention and streams."""

from __future__ import annotations

from dataclasses import replace
from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logharrow import registry
from logharrow.filters import Filter
from logharrow.functions.ip import is_valid_ip
from logharrow.operators import geo, routing
from logharrow.operators.raw import Cursor, recent_json
from logharrow.plans import maintain, reports, stored
from logharrow.schemas import conform
from logharrow.session import dealt, settled, work_dir
from logharrow.sources import commits, dimensions, messages, tables, textindex
from logharrow.streaming import framing, ingest, live
from workload import derive, render
from workload.catalog import query
from workload.dashboards import CLF_SQL, FIREWALL_SQL, PROXY_SQL, SOURCES_SQL, bounded
from workload.derive import AS_OF, sql

OK = "value >= 1"

# --- parse jobs: lines rendered from derived rows, parsed back -------------------

_UTC = "CAST({e} AS VARCHAR)"
_SECOND = _UTC.format(e="date_trunc('second', ts)")
_REQUEST = ("remote_host", "method", "path", "protocol", "status", "bytes")


def _parse(name: str, columns: dict[str, str], derivation: dict[str, str]) -> None:
    """Register the round trip of one type. ``columns``: output name to SQL over the fields."""
    fields = {**derivation, "ts": "ts", "value": "value"}
    exprs = ", ".join(f"{e} AS {n}" for n, e in columns.items())
    oracle = f"SELECT event_id, source_ip, {exprs} FROM ({sql(fields)}) WHERE {OK}"

    @query(f"{name}_parse", oracle)
    def _(spark, sf_dir):
        lines = render.envelope_of(derive.read(spark, sf_dir, "events"), name)
        parsed = registry.get(name).parse(lines).where("parsed")
        return parsed.withColumn("ts", F.col("ts").cast("string")).select("event_id", "source_ip", *columns)


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


_CLF_COLUMNS = {**_same(*_REQUEST, "ident", "auth_user", "referer", "user_agent"), "ts": _SECOND}
_parse("apache", _CLF_COLUMNS, derive.CLF)
_parse("nginx", _CLF_COLUMNS, derive.CLF)
_parse("traefik", {
    **_same(*_REQUEST, "host", "router", "service", "user_agent"),
    "ts": _UTC.format(e="ts"), "duration_ms": "value",
}, derive.PROXY)
_parse("caddy", {
    **_same(*_REQUEST, "host", "bytes_read", "user_agent", "referer"),
    "ts": _UTC.format(e="ts"), "duration_ms": "value * 1000",
}, derive.PROXY)
_parse("haproxy", {
    **_same(*_REQUEST, "frontend", "backend", "server", "termination"),
    "ts": _UTC.format(e="date_trunc('millisecond', ts)"),
    "duration_ms": "CASE WHEN duration_ms IS NOT NULL THEN floor(value) END",
}, derive.PROXY)
_FLOW = _same("action", "protocol", "src_ip", "src_port", "dst_ip", "src_zone", "dst_zone")
_parse("cisco_asa", {
    **_FLOW,
    "dst_port": "coalesce(dst_port, 0)",
    "rule": "CASE WHEN event_type = 'view' THEN '' ELSE concat('acl-', rule) END",
    "bytes": "CASE WHEN event_type = 'view' THEN bytes END",
    "event_type": "CASE WHEN action = 'deny' THEN '106023' WHEN event_type = 'view' THEN '302014' ELSE '106100' END",
    "application": "''",
    "ts": f"CASE WHEN event_id % 2 = 0 THEN {_SECOND} ELSE CAST(received_at AS VARCHAR) END",
}, derive.FIREWALL)
_parse("panos", {
    **_FLOW,
    **_same("dst_port", "bytes", "event_type"),
    "rule": "trim(concat('zone, \"a\", ', rule))",
    "application": "coalesce(application, '')",
    "ts": _SECOND,
}, derive.FIREWALL)


# --- envelope and routing -------------------------------------------------------

_HOST = "concat('host-', cast(user_id % 5 AS string))"


@query(
    "envelope_parse",
    f"SELECT {derive.ENVELOPE['source_ip']} AS source_ip, CASE WHEN user_id % 3 < 2 THEN {_HOST} END AS hostname, "
    "CASE user_id % 3 WHEN 0 THEN 'prog' WHEN 1 THEN 'app' END AS tag, "
    f"concat('body of ', {derive.REQUEST['path']}, ': done') AS raw FROM events",
)
def _(spark, sf_dir):
    lines = render.plain_messages(derive.read(spark, sf_dir, "events"))
    return messages.parse_envelope(lines).select("source_ip", "hostname", "tag", "raw")


@query(
    "frame_lines",
    "SELECT conv_id, line, count(*) AS n FROM (SELECT conv_id, unnest(string_split(replace(text, chr(13) || chr(10), "
    "chr(10)), chr(10))) AS line FROM conversations) GROUP BY 1, 2",
)
def _(spark, sf_dir):
    framed = derive.read(spark, sf_dir, "conversations").select(
        "conv_id", F.concat("text", F.lit("\r\n")).alias("payload")
    )
    lines = messages.split_lines(messages.decode_payload(framed))
    return lines.groupBy("conv_id", F.col("payload").alias("line")).agg(F.count("*").alias("n"))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as connections: all turns behind each other as bytes, cut every so many bytes, through characters too."""
    turns = derive.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    data = F.encode(F.concat(F.array_join("t.text", "\r\n"), F.lit("\nfin")), "UTF-8")
    width = F.lit(7) + F.col("conv_id") % 40
    cuts = turns.select("conv_id", data.alias("data"), width.cast("int").alias("width")).withColumn(
        "seq", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("data") - 1) / F.col("width")))))
    piece = F.expr("substring(data, int(seq * width) + 1, width)")
    at = F.timestamp_add("SECOND", F.col("seq"), F.lit(AS_OF).cast("timestamp_ntz"))
    return cuts.select(
        F.lit("10.0.0.1").alias("peer_ip"), F.col("conv_id").cast("string").alias("connection"), "seq", piece.alias("payload"), at.alias("received_at")
    )


_LINES = """SELECT CAST(conv_id AS VARCHAR) AS connection, CAST(i - 1 AS BIGINT) AS line, rtrim(lines[i], chr(13)) AS payload FROM (
    SELECT conv_id, lines, unnest(generate_series(1, len(lines))) AS i FROM (
    SELECT conv_id, string_split(concat(string_agg(text, concat(chr(13), chr(10)) ORDER BY turn, text), chr(10), 'fin'), chr(10)) AS lines
    FROM conversations GROUP BY conv_id))"""


@query("lines_over_payloads", _LINES)
def _(spark, sf_dir):
    return framing.lines_of(_pieces(spark, sf_dir)).select("connection", "line", "payload")


@query("lines_over_payloads_stream", _LINES)
def _(spark, sf_dir):
    """The same as a stream of four micro-batches, whose state carries open lines over; then all connections close."""
    root = work_dir(spark, "pieces")
    pieces = settled(_pieces(spark, sf_dir), "pieces")
    at_once = spark.sparkContext.defaultParallelism  # files of a batch: each is written by a task of its own
    last = pieces.groupBy("peer_ip", "connection").agg((F.max("seq") + 1).alias("seq"), F.max("received_at").alias("received_at"))
    closing = last.select("peer_ip", "connection", "seq", F.lit(None).cast("binary").alias("payload"), "received_at")
    for batch in range(4):
        part = pieces.where(F.pmod(F.floor(F.col("seq") / 9), F.lit(4)) == batch)  # later pieces overtake earlier ones
        (part.unionByName(closing) if batch == 3 else part).repartition(at_once).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(framing.PIECES).option("maxFilesPerTrigger", at_once).parquet(f"{root}/in")
    lines = framing.assemble(stream, idle_seconds=None)
    _run(lambda trigger: live.start_table(lines, f"{root}/table", f"{root}/checkpoint", "append", trigger))
    return live.read_table(spark, f"{root}/table", framing.LINES).select("connection", "line", "payload")


@query(
    "read_message_files",
    f"""SELECT {derive.ENVELOPE['source_ip']} AS peer_ip, concat('<13>', CASE WHEN event_id % 5 = 0 THEN '\ufffd' ELSE '' END,
        event_type, ' ', CAST(event_id AS VARCHAR)) AS payload, ts AS received_at FROM events""",
)
def _(spark, sf_dir):
    """Messages as bytes, every fifth with a byte that is no UTF-8, through files."""
    path = work_dir(spark, "messages")
    bad = F.when(F.col("event_id") % 5 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    parts = [F.lit("<13>").cast("binary"), bad, F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")).cast("binary")]
    events = derive.read(spark, sf_dir, "events")
    sender = F.expr(derive.ENVELOPE["source_ip"])
    at = F.col("ts").cast("timestamp_ntz")
    events.select(sender.alias("peer_ip"), F.concat(*parts).alias("payload"), at.alias("received_at")).write.parquet(path)
    stored = spark.read.schema("peer_ip string, payload binary, received_at timestamp_ntz").parquet(path)
    return messages.decode_payload(stored)


def _routed_sql() -> str:
    return (
        f"SELECT e.source_ip, e.received_at, e.value, s.log_type FROM (SELECT user_id, value, ts + INTERVAL 2 SECOND "
        f"AS received_at, {derive.ENVELOPE['source_ip']} AS source_ip FROM events) e LEFT JOIN ({SOURCES_SQL}) s "
        "ON e.source_ip = s.ip"
    )


def _envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.parse_envelope(render.messages(derive.read(spark, sf_dir, "events")))


@query(
    "route_sources",
    f"SELECT log_type, source_ip, count(*) AS n FROM ({_routed_sql()}) WHERE log_type IS NOT NULL GROUP BY 1, 2",
)
def _(spark, sf_dir):
    routed = routing.route(_envelopes(spark, sf_dir), derive.sources(spark, sf_dir))
    return routed.groupBy("log_type", "source_ip").agg(F.count("*").alias("n"))


@query(
    "route_sources_shuffled",
    f"SELECT log_type, source_ip, count(*) AS n FROM ({_routed_sql()}) WHERE log_type IS NOT NULL GROUP BY 1, 2",
)
def _(spark, sf_dir):
    routed = routing.route(_envelopes(spark, sf_dir), derive.sources(spark, sf_dir), broadcast=False)
    return routed.groupBy("log_type", "source_ip").agg(F.count("*").alias("n"))


@query(
    "unknown_sources",
    f"SELECT source_ip, count(*) AS n FROM ({_routed_sql()}) WHERE log_type IS NULL GROUP BY 1",
)
def _(spark, sf_dir):
    unknown = routing.unknown_senders(_envelopes(spark, sf_dir), derive.sources(spark, sf_dir))
    return unknown.groupBy("source_ip").agg(F.count("*").alias("n"))


_STATS = (
    "SELECT CAST(epoch(date_trunc('minute', received_at)) AS BIGINT) AS minute, count(*) AS received, "
    "count(*) FILTER (WHERE log_type IS NOT NULL AND value >= 1) AS stored, "
    "count(*) FILTER (WHERE log_type IS NOT NULL AND value < 1) AS unparsed, "
    f"count(*) FILTER (WHERE log_type IS NULL) AS unknown_source FROM ({_routed_sql()}) GROUP BY 1"
)


def _epoch_minute(stats: DataFrame) -> DataFrame:
    return stats.withColumn("minute", F.unix_timestamp("minute"))


@query("ingest_stats", _STATS)
def _(spark, sf_dir):
    lines = render.messages(derive.read(spark, sf_dir, "events"))
    return _epoch_minute(routing.minute_stats(ingest.outcomes(lines, derive.sources(spark, sf_dir))))


# --- geo ------------------------------------------------------------------------

_VISIT = f"SELECT event_id, {derive.VISITOR} AS address FROM events"
_OCTETS = " + ".join(
    f"CAST(split_part(trim(address), '.', {i + 1}) AS BIGINT) * {256 ** (3 - i)}" for i in range(4)
)
_VALID = (
    "regexp_full_match(trim(address), '[0-9.]+') AND CAST(split_part(trim(address), '.', 4) AS INTEGER) < 256"
)
_GEO = f"""SELECT v.event_id, v.address,
    CASE WHEN v.k IS NULL THEN 'Unknown' WHEN trim(v.address) LIKE '10.%' THEN 'Private network'
    WHEN coalesce(g.country_code, '') = '' THEN 'Unknown' ELSE coalesce(g.country, 'Unknown') END AS country,
    CASE WHEN v.k IS NULL OR trim(v.address) LIKE '10.%' THEN '' ELSE coalesce(g.country_code, '') END AS country_code
    FROM (SELECT *, CASE WHEN NOT regexp_full_match(trim(address), '[0-9.]+') THEN NULL
    WHEN CAST(split_part(trim(address), '.', 4) AS INTEGER) < 256 THEN {_OCTETS} END AS k FROM ({_VISIT})) v
    LEFT JOIN ({sql(derive.GEO, 'nation')}) g ON v.k BETWEEN g.lo AND g.hi"""


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.derive(
        derive.read(spark, sf_dir, "events"), {"event_id": "event_id", "address": derive.VISITOR}
    )


@query("geo_enrich", _GEO)
def _(spark, sf_dir):
    index = geo.build_index(derive.geo_ranges(spark, sf_dir))
    return geo.with_country(_visits(spark, sf_dir), "address", index)


@query("geo_enrich_shuffled", _GEO)
def _(spark, sf_dir):
    index = geo.build_index(derive.geo_ranges(spark, sf_dir))
    unbounded = replace(index, broadcast=False)
    return geo.with_country(_visits(spark, sf_dir), "address", unbounded)


# Networks within networks: a /16, a /24 for some of its parts, /29 within those, and single addresses.
_NETWORKS = """SELECT CASE WHEN n_nationkey = 0 THEN '203.0.0.0/16' WHEN n_nationkey < 6 THEN concat('203.0.', n_nationkey, '.77/24')
    WHEN n_nationkey % 5 = 0 THEN concat('203.0.', n_nationkey % 7, '.', n_nationkey * 8 - 7)
    ELSE concat('203.0.', n_nationkey % 7, '.', n_nationkey * 8, '/29') END AS network,
    concat('N', n_nationkey) AS country_code, n_name AS country FROM {nation}"""
_ADDRESS = derive.REQUEST["remote_host"]
_BITS = "CASE WHEN strpos(network, '/') = 0 THEN 32 ELSE CAST(split_part(network, '/', 2) AS INTEGER) END"


@query("geo_nested", f"""WITH nets AS (SELECT *, {_OCTETS.replace('trim(address)', "split_part(network, '/', 1)")} AS k, {_BITS} AS bits FROM ({_NETWORKS.format(nation='nation')})),
    seen AS (SELECT event_id, address, {_OCTETS} AS k FROM (SELECT event_id, {_ADDRESS} AS address FROM events))
    SELECT event_id, address, coalesce(country_code, '') AS country_code, coalesce(country, 'Unknown') AS country FROM (
    SELECT s.*, n.country_code, n.country, row_number() OVER (PARTITION BY event_id ORDER BY n.bits DESC) AS r FROM seen s
    LEFT JOIN nets n ON s.k >> (32 - n.bits) = n.k >> (32 - n.bits)) WHERE r = 1""")
def _(spark, sf_dir):
    """Networks from a CSV file, nested four deep; the longest prefix says the country."""
    path = work_dir(spark, "networks") + ".csv"
    spark.sql(_NETWORKS.format(nation="{nation}"), nation=derive.read(spark, sf_dir, "nation")).write.option("header", True).csv(path)
    visits = derive.derive(derive.read(spark, sf_dir, "events"), {"event_id": "event_id", "address": _ADDRESS})
    return geo.with_country(visits, "address", dimensions.load_geo_ranges(spark, path))


@query(
    "geo_without_table",
    "SELECT event_id, address, CASE WHEN trim(address) LIKE '10.%' THEN 'Private network' ELSE 'Unknown' END AS country, "
    f"'' AS country_code FROM ({_VISIT})",
)
def _(spark, sf_dir):
    return geo.with_country(_visits(spark, sf_dir), "address", None)


@query("valid_addresses", f"SELECT event_id, CASE WHEN NOT regexp_full_match(trim(address), '[0-9.]+') THEN false "
       f"ELSE CAST(split_part(trim(address), '.', 4) AS INTEGER) < 256 END AS valid FROM ({_VISIT})")
def _(spark, sf_dir):
    return _visits(spark, sf_dir).select("event_id", is_valid_ip(F.col("address")).alias("valid"))


# --- the sender table -----------------------------------------------------------

_CHANGES = {
    "ip": "CASE WHEN c_custkey % 5 = 4 THEN 'bad address' ELSE concat(' ', "
    + derive.SOURCES["ip"].replace("s_suppkey", "(c_custkey * 2)") + ") END",
    "name": "CASE WHEN c_custkey % 7 = 6 THEN '  ' ELSE concat(c_name, ' ') END",
    "log_type": "CASE WHEN c_custkey % 11 = 10 THEN 'unheard of' ELSE 'nginx' END",
}
_GOOD = f"SELECT trim(ip) AS ip, trim(name) AS name, log_type FROM ({sql(_CHANGES, 'customer')}) " \
    "WHERE ip <> 'bad address' AND trim(name) <> '' AND log_type = 'nginx'"


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.derive(derive.read(spark, sf_dir, "customer"), _CHANGES)


@query(
    "upsert_source",
    f"SELECT g.ip, g.name, g.log_type, coalesce(s.created_at, TIMESTAMP '{AS_OF}') AS created_at FROM ({_GOOD}) g "
    f"LEFT JOIN ({SOURCES_SQL}) s ON g.ip = s.ip UNION ALL SELECT ip, name, log_type, created_at FROM ({SOURCES_SQL}) "
    f"WHERE ip NOT IN (SELECT ip FROM ({_GOOD}))",
)
def _(spark, sf_dir):
    path = work_dir(spark, "sources")
    dimensions.save_sources(spark, derive.sources(spark, sf_dir), path)
    stored = dimensions.load_sources(spark, path)
    dimensions.save_sources(spark, dimensions.upsert_sources(stored, _changes(spark, sf_dir), AS_OF), path)
    return dimensions.load_sources(spark, path)


@query(
    "two_editors",
    f"SELECT g.ip, g.name, g.log_type, coalesce(s.created_at, TIMESTAMP '{AS_OF}') AS created_at FROM ({_GOOD}) g "
    f"LEFT JOIN ({SOURCES_SQL}) s ON g.ip = s.ip WHERE g.ip <> '10.0.0.7' UNION ALL SELECT ip, name, log_type, created_at "
    f"FROM ({SOURCES_SQL}) WHERE ip NOT IN (SELECT ip FROM ({_GOOD})) AND ip <> '10.0.0.7'",
)
def _(spark, sf_dir):
    """An edit that another overtakes is refused, and made again on what the other left."""
    path = work_dir(spark, "editors")
    version = dimensions.save_sources(spark, derive.sources(spark, sf_dir), path)
    mine = dimensions.load_sources(spark, path, version)
    dimensions.edit_sources(spark, path, lambda rows: dimensions.upsert_sources(rows, _changes(spark, sf_dir), AS_OF))
    try:
        dimensions.save_sources(spark, dimensions.delete_source(mine, "10.0.0.7"), path, version)
        raise AssertionError("an edit of an old version was taken")
    except dimensions.EditConflict:
        dimensions.edit_sources(spark, path, lambda rows: dimensions.delete_source(rows, "10.0.0.7"))
    return dimensions.load_sources(spark, path)


@query(
    "reject_source",
    f"""SELECT trim(ip) AS ip, trim(name) AS name, log_type, CASE WHEN log_type <> 'nginx' THEN 'unknown log type'
        WHEN trim(name) = '' THEN 'name is required' ELSE 'not a valid IP address' END AS problem
        FROM ({sql(_CHANGES, 'customer')}) WHERE ip = 'bad address' OR trim(name) = '' OR log_type <> 'nginx'""",
)
def _(spark, sf_dir):
    return dimensions.rejected_sources(_changes(spark, sf_dir))


@query("delete_source", f"SELECT * FROM ({SOURCES_SQL}) WHERE ip <> '10.0.0.7'")
def _(spark, sf_dir):
    return dimensions.delete_source(derive.sources(spark, sf_dir), " 10.0.0.7 ")


@query("list_sources", SOURCES_SQL)
def _(spark, sf_dir):
    return dimensions.list_sources(derive.sources(spark, sf_dir))


# --- stored tables --------------------------------------------------------------

def _by_day(df: DataFrame) -> DataFrame:
    age = F.coalesce("ts", "received_at")
    return df.groupBy(F.to_date(age).cast("string").alias("day")).agg(
        F.count("*").alias("n"), F.count("ts").alias("timed"), F.sum("bytes").alias("bytes"),
        F.min("raw").alias("first"), F.max("raw").alias("last"),
    )


def by_day_sql(table: str, where: str = "true") -> str:
    return (
        "SELECT CAST(CAST(coalesce(ts, received_at) AS DATE) AS VARCHAR) AS day, count(*) AS n, count(ts) AS timed, "
        f"CAST(sum(bytes) AS BIGINT) AS bytes, min(raw) AS first, max(raw) AS last FROM ({table}) WHERE {where} GROUP BY 1"
    )


def _store(spark: SparkSession, sf_dir: str, purpose: str, batches: int = 2) -> str:
    """A fresh table root with the derived rows stored as some batches."""
    root = work_dir(spark, purpose)
    tables.init_tables(spark, root)
    events = settled(dealt(derive.read(spark, sf_dir, "events")), "events")  # a file that every task can read a part of
    for name, columns in (("apache", derive.CLF), ("panos", derive.FIREWALL)):
        rows = conform(derive.derive(events, columns), registry.get(name).schema)
        for batch in range(batches):
            part = rows.where(F.pmod(F.xxhash64("raw"), F.lit(batches)) == batch)
            tables.append_batch(part, tables.table_path(root, name), tables.stream_batch("given", batch))
    return root


@query("store_and_read", by_day_sql(CLF_SQL))
def _(spark, sf_dir):
    root = _store(spark, sf_dir, "store")
    return _by_day(tables.open_table(spark, root, "apache"))


@query("store_twice", by_day_sql(CLF_SQL))
def _(spark, sf_dir):
    root = work_dir(spark, "twice")
    rows = conform(derive.clf(spark, sf_dir), registry.get("nginx").schema)
    for _attempt in range(2):
        tables.append_batch(rows, tables.table_path(root, "nginx"), "given-5")
    return _by_day(tables.open_table(spark, root, "nginx"))


_CUTOFF = f"TIMESTAMP '{AS_OF - timedelta(days=12, hours=7)}'"
_PRUNE_AS_OF = AS_OF - timedelta(hours=7)


@query(
    "prune_12d",
    " UNION ALL ".join(
        f"SELECT '{name}' AS log_type, * FROM ({by_day_sql(table, f'coalesce(ts, received_at) >= {_CUTOFF}')})"
        for name, table in (("apache", CLF_SQL), ("panos", FIREWALL_SQL))
    ),
)
def _(spark, sf_dir):
    root = _store(spark, sf_dir, "prune")
    maintain.prune(spark, root, 12, _PRUNE_AS_OF)
    return reduce(DataFrame.unionAll, [
        _by_day(tables.open_table(spark, root, name)).select(F.lit(name).alias("log_type"), "*")
        for name in ("apache", "panos")
    ])


@query(
    "prune_count",
    " UNION ALL ".join(
        f"SELECT '{name}' AS log_type, count(*) AS removed FROM ({table}) WHERE coalesce(ts, received_at) < {_CUTOFF}"
        for name, table in (("apache", CLF_SQL), ("panos", FIREWALL_SQL))
    ),
)
def _(spark, sf_dir):
    root = _store(spark, sf_dir, "removed")
    removed = maintain.prune(spark, root, 12, _PRUNE_AS_OF)
    rows = [(name, removed[name]) for name in ("apache", "panos")]
    return spark.createDataFrame(rows, "log_type string, removed bigint")


@query("survivors_keep_all", by_day_sql(CLF_SQL))
def _(spark, sf_dir):
    return _by_day(maintain.survivors(derive.clf(spark, sf_dir), 0, AS_OF))


def _both_sql(where: str = "true") -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS log_type, * FROM ({by_day_sql(table, where)})"
        for name, table in (("apache", CLF_SQL), ("panos", FIREWALL_SQL))
    )


def _both_by_day(spark: SparkSession, root: str) -> DataFrame:
    return reduce(DataFrame.unionAll, [
        _by_day(tables.open_table(spark, root, name)).select(F.lit(name).alias("log_type"), "*")
        for name in ("apache", "panos")
    ])


@query("compact_days", _both_sql())
def _(spark, sf_dir):
    root = _store(spark, sf_dir, "compact", 12)
    done = maintain.compact(spark, root, AS_OF.date() + timedelta(days=1))
    if not (done["apache"] and done["panos"]):
        raise AssertionError("no day was compacted")
    return _both_by_day(spark, root)


@query("maintain_all", _both_sql(f"coalesce(ts, received_at) >= {_CUTOFF}"))
def _(spark, sf_dir):
    root = _store(spark, sf_dir, "maintain", 12)
    maintain.run(spark, root, 12, _PRUNE_AS_OF)
    return _both_by_day(spark, root)


_CLF_COLUMNS = registry.get("apache").schema.names


@query("conform_schema", "SELECT " + ", ".join(
    f"CAST(NULL AS VARCHAR) AS {c}" if c in ("country", "country_code") else c for c in _CLF_COLUMNS
) + f" FROM ({CLF_SQL})")
def _(spark, sf_dir):
    old = derive.clf(spark, sf_dir).drop("country", "country_code")
    return conform(old, registry.get("apache").schema)


_RECENT = ("source_ip", "remote_host", "auth_user", "ts", "method", "path", "protocol", "status", "bytes", "user_agent", "received_at")


@query(
    "recent_json",
    "SELECT to_json(struct_pack(" + ", ".join(
        f"{c} := CAST({c} AS VARCHAR)" if c in ("ts", "received_at") else f"{c} := {c}" for c in _RECENT
    ) + f"))::VARCHAR AS value FROM (SELECT * FROM ({CLF_SQL}) ORDER BY received_at DESC, raw LIMIT 50)",
)
def _(spark, sf_dir):
    return recent_json(derive.clf(spark, sf_dir))


@query(
    "export_file",
    "SELECT CAST(row_number() OVER (ORDER BY ts DESC, received_at DESC, raw) AS INTEGER) AS pos, "
    f"concat(CAST(ts AS VARCHAR), ' ', raw) AS value FROM ({FIREWALL_SQL}) WHERE ts >= TIMESTAMP '{AS_OF}' - "
    "INTERVAL 7 DAY AND action = 'deny'",
)
def _(spark, sf_dir):
    path = work_dir(spark, "export")
    chosen = Filter(range="7d", action="deny")
    reports.export_report(derive.firewall(spark, sf_dir), chosen, AS_OF, registry.get("panos"), path)
    # The files by name, one behind the other, give the order of the lines; a file is read in order.
    files = spark.read.text(path)
    lines = files.select(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("i"), "value",
    ).where("value <> ''")
    lines = settled(lines, "export-lines")
    own = Window.partitionBy("file").orderBy("block", "i")
    sizes = lines.groupBy("file").agg(F.count("*").alias("n"))  # a row for each file
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("file", before.alias("before"))
    return lines.join(F.broadcast(starts), "file").select((F.col("before") + F.row_number().over(own)).cast("int").alias("pos"), "value")


# --- what the log of commits is for -----------------------------------------------

@query("snapshot_read", by_day_sql(CLF_SQL))
def _(spark, sf_dir):
    """A scan begun before retention and compaction ends with the old rows, though they are gone for others."""
    root = _store(spark, sf_dir, "snapshot", 12)
    with commits.pinned(spark, root) as then:
        held = tables.open_table(spark, root, "apache", then)
        maintain.run(spark, root, 12, _PRUNE_AS_OF)
        if tables.open_table(spark, root, "apache").count() >= held.count():
            raise AssertionError("nothing was pruned")
        return settled(_by_day(held), "held")


@query("snapshot_after", _both_sql(f"coalesce(ts, received_at) >= {_CUTOFF}"))
def _(spark, sf_dir):
    """The same tables for who looks later, once the pin is gone and the old files are deleted."""
    root = _store(spark, sf_dir, "snapshot", 12)
    with commits.pinned(spark, root):
        maintain.run(spark, root, 12, _PRUNE_AS_OF)
    commits.sweep(spark, root)
    if commits.latest(spark, root).dropped:
        raise AssertionError("dropped files are still there")
    return _both_by_day(spark, root)


@query("batch_atomic", f"""SELECT s.log_type, count(*) AS n FROM (SELECT {derive.ENVELOPE['source_ip']} AS source_ip FROM events
    WHERE value >= 1 AND event_id % 2 = 0) e JOIN ({SOURCES_SQL}) s ON e.source_ip = s.ip GROUP BY 1""")
def _(spark, sf_dir):
    """Two batches of all types; the second one dies while its third table is written, and shows nowhere."""
    root = work_dir(spark, "atomic")
    tables.init_tables(spark, root)
    events, sources = derive.read(spark, sf_dir, "events"), derive.sources(spark, sf_dir)
    ingest.store_batch(render.messages(events.where("event_id % 2 = 0")), 0, root, sources, None, "atomic")
    real, left = ingest.write_attempt, [3]

    def dying(*args):
        left[0] -= 1
        if not left[0]:
            raise OSError("the driver died")
        return real(*args)

    ingest.write_attempt = dying
    try:
        ingest.store_batch(render.messages(events.where("event_id % 2 = 1")), 1, root, sources, None, "atomic")
    except OSError:
        pass
    finally:
        ingest.write_attempt = real
    counts = reduce(DataFrame.unionAll, [
        tables.open_table(spark, root, name).groupBy(F.lit(name).alias("log_type")).agg(F.count("*").alias("n"))
        for name in registry.names()
    ])
    return counts.where("n > 0")


_PAGE = f"""SELECT CAST(row_number() OVER (ORDER BY ts DESC, received_at DESC, raw) AS INTEGER) AS pos, CAST(ts AS VARCHAR) AS ts, raw AS line
    FROM ({FIREWALL_SQL}) WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND action = 'deny'"""


@query("stored_page", f"SELECT * FROM ({_PAGE}) WHERE pos <= 120")
def _(spark, sf_dir):
    """Two pages, one behind the other, each from the newest files that can hold it."""
    root = _store(spark, sf_dir, "page", 12)
    maintain.compact(spark, root, AS_OF.date() + timedelta(days=1), target=1 << 16)
    now, chosen = commits.latest(spark, root), Filter(range="7d", action="deny", limit=60)
    first = stored.stored_page(spark, "panos", chosen, AS_OF, now)
    last = first.where("pos = 60").select("key.*").first()
    more = stored.stored_page(spark, "panos", chosen, AS_OF, now, after=Cursor(**last.asDict())) if last else first.limit(0)
    return first.select("pos", "ts", "line").union(more.select(F.col("pos") + 60, "ts", "line"))


@query("stored_recent", f"""SELECT source_ip, remote_host, CAST(received_at AS VARCHAR) AS received_at, path, status, bytes
    FROM ({CLF_SQL}) ORDER BY received_at DESC, raw LIMIT 50""")
def _(spark, sf_dir):
    root = _store(spark, sf_dir, "recent", 12)
    rows = stored.stored_recent(spark, "apache", commits.latest(spark, root))
    return rows.select("source_ip", "remote_host", "received_at", "path", "status", "bytes")


def _found_sql(text: str) -> str:
    from workload.dashboards import PANOS

    any_of = " OR ".join(f"CAST({c} AS VARCHAR) ILIKE '%{text}%'" for c in PANOS.search)
    return f"SELECT '{text}' AS q, raw, src_ip, rule FROM ({FIREWALL_SQL}) WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND ({any_of})"


_SEARCHES = ("ERROR", "line 4_77 ", "rule-2%9", "10.0.0.1", "zz", "No Such Text")


@query("stored_search", " UNION ALL ".join(map(_found_sql, _SEARCHES)))
def _(spark, sf_dir):
    """Searches of stored tables that skip files by their trigrams, after a compaction into many small files."""
    least, textindex.LEAST_BYTES = textindex.LEAST_BYTES, 0  # the given tables make small files
    try:
        root = _store(spark, sf_dir, "search", 4)
        maintain.compact(spark, root, AS_OF.date() + timedelta(days=1), target=1 << 14)
    finally:
        textindex.LEAST_BYTES = least
    now = commits.latest(spark, root)
    return reduce(DataFrame.unionAll, [
        stored.rows_in_range(spark, "panos", Filter(range="30d", q=q), AS_OF, now).select(F.lit(q).alias("q"), "raw", "src_ip", "rule")
        for q in _SEARCHES
    ])


# --- streams --------------------------------------------------------------------

def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = derive.read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _run(start) -> None:
    stream = start(trigger={"availableNow": True})
    stream.awaitTermination()


@query(
    "stream_timeline",
    f"SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS bucket, count(*) AS count FROM ({CLF_SQL}) "
    f"WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY 1",
)
def _(spark, sf_dir):
    root = work_dir(spark, "live")
    from workload.dashboards import WEB

    rows = bounded(derive.derive(_event_stream(spark, sf_dir), derive.CLF), WEB, "30d")
    counts = live.live_counts(rows, "24h")
    _run(lambda trigger: live.start_table(counts, f"{root}/table", f"{root}/checkpoint", trigger=trigger))
    return live.read_table(spark, f"{root}/table", counts.schema)


@query("stream_stats", _STATS)
def _(spark, sf_dir):
    root = work_dir(spark, "stats")
    lines = render.messages(_event_stream(spark, sf_dir))
    stats = ingest.stream_stats(ingest.outcomes(lines, derive.sources(spark, sf_dir)))
    _run(lambda trigger: live.start_table(stats, f"{root}/table", f"{root}/checkpoint", trigger=trigger))
    return _epoch_minute(live.read_table(spark, f"{root}/table", stats.schema))


# What the ingest stream must have stored, by type, sender and day.
_STORED = f"""SELECT s.log_type, s.ip AS source_ip, CAST(CAST(CASE WHEN s.log_type = 'cisco_asa' AND event_id % 2 = 1
    THEN received_at ELSE ts END AS DATE) AS VARCHAR) AS day,
    coalesce(CASE WHEN coalesce(g.country_code, '') <> '' THEN coalesce(g.country, 'Unknown') END, 'Unknown') AS country,
    count(*) AS n FROM (SELECT *, ts + INTERVAL 2 SECOND AS received_at, {derive.ENVELOPE['source_ip']} AS source_ip,
    {_OCTETS.replace('trim(address)', derive.REQUEST['remote_host'])} AS k FROM events WHERE value >= 1) e
    JOIN ({SOURCES_SQL}) s ON e.source_ip = s.ip LEFT JOIN ({sql(derive.GEO, 'nation')}) g ON e.k BETWEEN g.lo AND g.hi
    GROUP BY 1, 2, 3, 4"""


def _ingest(spark: SparkSession, sf_dir: str, streams: int = 1) -> str:
    """A root into which some streams, each with its own checkpoint, have stored all messages."""
    root, sources_path = work_dir(spark, "ingest"), work_dir(spark, "ingest-sources")
    tables.init_tables(spark, root)
    dimensions.save_sources(spark, derive.sources(spark, sf_dir), sources_path)
    index = geo.build_index(derive.geo_ranges(spark, sf_dir))
    for number in range(streams):
        _run(lambda trigger: ingest.start_ingest(
            render.messages(dealt(_event_stream(spark, sf_dir))), root, f"{root}-checkpoint-{number}",
            lambda session: dimensions.load_sources(session, sources_path), index, trigger,
        ))
    return root


def _stored(spark: SparkSession, root: str) -> DataFrame:
    stored = reduce(DataFrame.unionAll, [
        tables.open_table(spark, root, name).select(
            F.lit(name).alias("log_type"), "source_ip", "country", F.col("event_date").cast("string").alias("day")
        )
        for name in registry.names()
    ])
    return stored.groupBy("log_type", "source_ip", "day", "country").agg(F.count("*").alias("n"))


@query("stream_ingest", _STORED)
def _(spark, sf_dir):
    return _stored(spark, _ingest(spark, sf_dir))


@query("two_streams_store", f"SELECT log_type, source_ip, day, country, 2 * n AS n FROM ({_STORED})")
def _(spark, sf_dir):
    return _stored(spark, _ingest(spark, sf_dir, streams=2))


@query("stream_ingest_stats", _STATS)
def _(spark, sf_dir):
    return _epoch_minute(ingest.ingest_stats(spark, _ingest(spark, sf_dir)))


@query("geo_enrich_v6_hot_prefix", """SELECT event_id, CASE WHEN user_id % 2 = 0 THEN concat('C', CAST(user_id % 500 AS VARCHAR)) ELSE '' END
    AS country_code FROM events""")
def _(spark, sf_dir):
    """All addresses in one IPv6 /32, every second /48 of it in a range, looked up without broadcast."""
    part = lambda c: F.concat(F.lit("2001:db8:"), F.lower(F.hex(c)))
    even = spark.range(0, 500, 2)
    ranges = even.select(
        F.concat(part("id"), F.lit("::")).alias("lo"), F.concat(part("id"), F.lit(":ffff::")).alias("hi"),
        F.concat(F.lit("C"), F.col("id").cast("string")).alias("country_code"), F.lit("x").alias("country"),
    )
    events = derive.read(spark, sf_dir, "events").select(
        "event_id", F.concat(part(F.col("user_id").cast("bigint") % 500), F.lit("::"), F.hex(F.col("event_id") % 9999)).alias("a")
    )
    index = replace(geo.build_index(ranges), broadcast=False)
    return geo.with_country(events, "a", index).select("event_id", "country_code")


# Every message is routed and parsed; the lines of senders 0 and 4 of each seven are in the format of both types.
@query("edits_between_batches", f"""SELECT log_type, count(*) FILTER (WHERE value >= 1 AND user_id % 7 IN (0, 4)) AS n FROM (
    SELECT CASE WHEN event_id % 2 = 0 THEN 'apache' ELSE 'nginx' END AS log_type, value, user_id FROM events
    WHERE {derive.ENVELOPE['source_ip']} IN (SELECT ip FROM ({SOURCES_SQL}))) GROUP BY 1""")
def _(spark, sf_dir):
    """A sender table edited between two batches of all messages: each batch goes by the table of its time."""
    root = work_dir(spark, "edits")
    tables.init_tables(spark, root)
    events = dealt(derive.read(spark, sf_dir, "events"))
    sources = derive.sources(spark, sf_dir)
    for number, log_type in enumerate(("apache", "nginx")):
        edited = sources.withColumn("log_type", F.lit(log_type))
        batch = render.messages(events.where(F.col("event_id") % 2 == number))
        ingest.store_batch(batch, number, root, edited, None, "edited")
    return reduce(DataFrame.unionAll, [
        tables.open_table(spark, root, name).groupBy(F.lit(name).alias("log_type")).agg(F.count("*").alias("n"))
        for name in ("apache", "nginx")
    ])
