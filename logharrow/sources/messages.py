"""Reading messages and taking the syslog envelope off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logharrow.functions.text import UNICODE, group, match_groups, matched
from logharrow.operators.pin import pin
from logharrow.schemas import RAW_ENVELOPE

# Header shapes. Loops over free text are possessive, so long
# structured data cannot make the regex engine recurse.
_STRUCTURED = r'(?:-|(?:\[(?:[^\]\\"]|\\.|"(?:[^"\\]|\\.)*+")*+\])++)'
RFC5424 = rf"^<\d{{1,3}}>1 (\S+) (\S+) (\S+) (\S+) (\S+) {_STRUCTURED}(?: ((?s:.*)))?\z"
RFC3164 = (
    r"^<\d{1,3}>\s*"
    r"(?:(?:[A-Z][a-z]{2}\s+\d{1,2}(?:\s+\d{4})?\s+\d{2}:\d{2}:\d{2}|\d{4}-\d{2}-\d{2}T\S+):?\s+"
    r"(?:([^\s:%,\[{\"]+)\s+)?)?"  # a host only after a time
    r"(?:([^\s:\[{\"]+)(?:\[\d+\])?:(?:\s+|\z))?"  # program name, ended by a colon
    r"((?s:.*))\z"
)


def read_messages(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    streaming: bool = False,
    **options: str,
) -> DataFrame:
    """Message rows (``peer_ip``, ``payload``, ``received_at``) from files.

    ``payload`` may be text or bytes; bytes that are not UTF-8 become U+FFFD.
    """
    reader = spark.readStream if streaming else spark.read
    return decode_payload(reader.format(fmt).schema(RAW_ENVELOPE).options(**options).load(path))


def read_kafka(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Message stream from Kafka: the key is the sender address, the value a message.

    Needs the Kafka connector on the class path; the cluster provides it.
    """
    stream = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .options(**options)
        .load()
    )
    return decode_payload(
        stream.select(
            F.col("key").cast("string").alias("peer_ip"),
            F.col("value").alias("payload"),
            F.col("timestamp").cast("timestamp_ntz").alias("received_at"),
        )
    )


def decode_payload(messages: DataFrame) -> DataFrame:
    """Lossy UTF-8: bytes that do not decode become the replacement character."""
    return messages.withColumn("payload", F.make_valid_utf8(F.col("payload").cast("string")))


def split_lines(messages: DataFrame) -> DataFrame:
    """One row per line of a payload that holds a newline-framed byte stream."""
    lines = F.split(F.col("payload"), "\r?\n", -1)
    # A final newline ends the last line; it does not begin an empty one.
    complete = F.when(
        F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)
    ).otherwise(lines)
    return messages.withColumn("payload", F.explode(complete))


def _known(value: Column) -> Column:
    return F.when(~value.isin("-", ""), value)


def parse_envelope(messages: DataFrame) -> DataFrame:
    """Host, tag and body of each message, RFC 5424 tried first, then RFC 3164.

    Priority and header time are ignored: a message is dated by its arrival. A
    message in neither form is kept whole as the body.
    """
    line, new, old = F.col("payload"), F.col("_new"), F.col("_old")
    is_new, is_old = matched(new), matched(old)
    first_look = F.rlike(line, F.lit(UNICODE + r"^<\d{1,3}>1 "))
    return (
        pin(
            pin(messages, _new=F.when(first_look, match_groups(line, RFC5424, 6))),
            _old=F.when(~is_new, match_groups(line, RFC3164, 3)),
        ).select(
            F.col("peer_ip").alias("source_ip"),
            F.when(is_new, _known(group(new, 2))).otherwise(F.nullif(group(old, 1), F.lit(""))).alias("hostname"),
            F.when(is_new, _known(group(new, 3))).otherwise(F.nullif(group(old, 2), F.lit(""))).alias("tag"),
            F.when(is_new, group(new, 6)).when(is_old, group(old, 3)).otherwise(line).alias("raw"),
            "received_at",
        )
    )
