"""A timeline kept up to date by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from logharrow.functions.time import bucket
from logharrow.sources.files import exists, list_dirs, version_path, versions, write_version
from logharrow.sources.tables import stream_batch


def live_counts(events: DataFrame, range_: str) -> DataFrame:
    """Running rows per timeline bucket; state grows with buckets, not with rows."""
    return events.groupBy(bucket(F.col("ts"), range_).alias("bucket")).agg(F.count("*").alias("count"))


def start_table(
    frame: DataFrame, path: str, checkpoint: str, mode: str = "complete", trigger: dict | None = None
) -> StreamingQuery:
    """Keep the result of a streaming aggregate in a folder, for ``read_table``.

    ``complete`` results replace each other as versions. ``append`` results are final
    rows, kept by stream and batch. Updates to earlier rows have no key here, so ``update``
    is refused.
    """
    if mode not in ("complete", "append"):
        raise ValueError(f"cannot keep a table in mode '{mode}'")

    def each_batch(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        if mode == "complete":
            write_version(session, batch, path, number)
        else:
            batch.persist()  # else the look for a row would run the whole batch, state and all, once more
            try:
                if not batch.isEmpty():
                    stream = session.sparkContext.getLocalProperty("sql.streaming.queryId")
                    batch.write.mode("overwrite").parquet(f"{path}/batch={stream_batch(stream, number)}")
            finally:
                batch.unpersist()

    return (
        frame.writeStream.outputMode(mode)
        .foreachBatch(each_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )


def read_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """What ``start_table`` has kept so far; no rows before its first batch."""
    kept = versions(spark, path)
    if kept:
        return spark.read.schema(schema).parquet(version_path(path, kept[-1]))
    whole = [d for d in list_dirs(spark, path) if d.startswith("batch=") and exists(spark, f"{path}/{d}/_SUCCESS")]
    if not whole:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{d}" for d in whole])
