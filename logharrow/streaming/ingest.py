"""Continuous ingest: messages in, event tables out."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logharrow import registry
from logharrow.operators.geo import GeoIndex
from logharrow.operators.lookup import fits
from logharrow.operators.routing import mark_outcome, minute_stats
from logharrow.schemas import with_event_date
from logharrow.session import dealt
from logharrow.sources import commits, files
from logharrow.sources.dimensions import unique_sources
from logharrow.sources.messages import parse_envelope
from logharrow.sources.rewrites import described
from logharrow.sources.tables import (
    as_events, batch_of, commit_batch, staged, stream_batch, table_path, write_attempt,
)

# Where batches are counted.
STATS = "ingest_stats"
# Types parsed and stored at the same time; what one does alone, like naming its files, keeps no core from the others.
TYPES_AT_ONCE = 4


def store_batch(
    messages: DataFrame,
    number: int,
    root: str,
    sources: DataFrame,
    geo: GeoIndex | None,
    stream: str = "batch",
) -> None:
    """Route, parse, enrich and store one batch of a stream, and count what became of it.

    All tables and the counts per minute show the batch with one commit: a crash before it leaves
    nothing to be seen, and readers never see some of the tables. Storing a batch again replaces it
    in every table, also where the sender table was edited between the tries, so a retry neither
    loses nor doubles rows; a batch before the stream's last, or whose rows were pruned or compacted
    since, is left alone. Rows are
    dated by their own time, however old: there is no lateness limit. Each line is parsed once; the
    counts, those of unknown senders and unparsed lines among them, come from the same parse and are
    read with ``ingest_stats``. Messages are dealt out over all cores, however few parts the batch comes in.
    """
    spark = messages.sparkSession
    batch, names = stream_batch(stream, number), [*registry.names(), STATS]
    if _merged(spark, root, stream, number):
        return
    for name in names:
        commits.adopt(spark, root, name, commits.listed if name == STATS else described)
    sources = unique_sources(sources.where(F.col("log_type").isin(registry.names())))
    routed = mark_outcome(parse_envelope(dealt(messages)), sources, fits(sources)).persist()
    held = [routed]
    try:
        with staged(spark, root, batch) as attempt:
            counts = [_counts(routed.where(F.col("log_type").isNull()).withColumn("parsed", F.lit(False)))]
            # Only types some sender is configured for; bounded by the registry.
            types = sorted(r.log_type for r in sources.select("log_type").distinct().collect())
            for name in types:
                held.append(registry.get(name).parse(routed.where(F.col("log_type") == name)).persist())
                counts.append(_counts(held[-1]))

            def store(name: str, parsed: DataFrame) -> list[commits.Key]:
                events = as_events(parsed.drop("log_type"), name, geo)
                return write_attempt(with_event_date(events), table_path(root, name), attempt)

            with ThreadPoolExecutor(TYPES_AT_ONCE) as pool:
                folders = sum(pool.map(inheritable_thread_target(spark)(store), types, held[1:]), [])
            stats = minute_totals(reduce(DataFrame.unionByName, counts))
            dated = stats.withColumn("event_date", F.to_date("minute")).coalesce(1)  # a row per minute of the batch
            minutes = write_attempt(dated, table_path(root, STATS), attempt)
            portions = described(spark, root, folders)
            rows = sum(p.rows for p in portions)
            portions += commits.listed(spark, root, minutes)
            commit_batch(spark, root, batch, portions, names, {stream: [number, rows]})
    finally:
        for frame in held:
            frame.unpersist()


def _merged(spark: SparkSession, root: str, stream: str, number: int) -> bool:
    """Whether a batch was stored and cannot be replaced: one before the stream's last, which no stream
    tries again, or the last one if its rows have been pruned or merged with others since."""
    now = commits.latest(spark, root)
    last, rows = now.streams.get(stream, [-1, 0])
    batch = stream_batch(stream, number)
    live = sum(p.rows for p in now.live.values() if p.table != STATS and batch_of(p.batch) == batch)
    return number < last or number == last and live < rows


def _counts(rows: DataFrame) -> DataFrame:
    minute = F.date_trunc("minute", F.col("received_at")).cast("timestamp_ntz")
    return minute_stats(rows.select(minute.alias("received_at"), "log_type", "parsed"))


def minute_totals(counts: DataFrame) -> DataFrame:
    """Counts of the same minute from several places added up."""
    kinds = ("received", "stored", "unparsed", "unknown_source")
    return counts.groupBy("minute").agg(*[F.sum(c).alias(c) for c in kinds])


def ingest_stats(spark: SparkSession, root: str, snapshot: commits.Snapshot | None = None) -> DataFrame:
    """Per-minute counts of everything stored under ``root``: a few rows for each batch are read."""
    schema = "minute timestamp_ntz, received long, stored long, unparsed long, unknown_source long"
    path = table_path(root, STATS)
    snapshot = snapshot or commits.latest(spark, root)
    if STATS in snapshot.tables:
        found = [f"{root.rstrip('/')}/{p.folder}/{f.name}" for p in snapshot.of(STATS) for f in p.files]
    else:  # counted before there was a log
        found = [path] if files.exists(spark, path) else []
    if not found:
        return spark.createDataFrame([], schema)
    return minute_totals(spark.read.schema(schema).option("basePath", path).parquet(*found))


def outcomes(
    messages: DataFrame, sources: DataFrame, broadcast: bool | None = None
) -> DataFrame:
    """What becomes of each message: ``received_at``, ``log_type``, ``parsed``.

    One scan: every parser looks at each row, but sees a line only where the row is
    of its type, and columns other than the verdict are never computed.
    """
    routed = mark_outcome(parse_envelope(messages), sources, broadcast)
    types_of: dict[Callable, list[str]] = {}
    for name, spec in registry.REGISTRY.items():
        types_of.setdefault(spec.parse, []).append(name)
    line, verdicts = F.col("raw"), []
    for parse, names in types_of.items():
        own = F.when(F.col("log_type").isin(*names), line)
        seen = parse(routed.withColumns({"_raw": line, "raw": own}))
        verdicts.append(f"_parsed_{names[0]}")
        kept = [F.col(c) for c in routed.columns if c != "raw"]
        routed = seen.select(*kept, F.col("_raw").alias("raw"), F.col("parsed").alias(verdicts[-1]))
    parsed = F.lit(False)
    for verdict in verdicts:
        parsed = parsed | F.coalesce(F.col(verdict), F.lit(False))
    return routed.select("received_at", "log_type", parsed.alias("parsed"))


def start_ingest(
    messages: DataFrame,
    root: str,
    checkpoint: str,
    load_sources: Callable[[SparkSession], DataFrame],
    geo: GeoIndex | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start the ingest stream.

    ``load_sources`` is called for every batch, so an edited sender table takes
    effect with the next one. ``checkpoint`` must be on storage all nodes share.
    """

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        # The id of the query is kept in its checkpoint: a fresh checkpoint is another stream.
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        store_batch(batch, batch_id, root, load_sources(batch.sparkSession), geo, stream)

    return (
        messages.writeStream.foreachBatch(each_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )


def stream_stats(outcome_rows: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Per-minute ingest counts as a stream; a minute is final after ``delay``."""
    timed = outcome_rows.withColumn("received_at", F.col("received_at").cast("timestamp"))
    return minute_stats(timed.withWatermark("received_at", delay))
