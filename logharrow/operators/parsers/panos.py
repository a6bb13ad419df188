"""PAN-OS TRAFFIC records: comma-separated, quotes anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logharrow.functions.text import strip, to_number
from logharrow.functions.time import parse_naive_time
from logharrow.operators.parsers.firewall import normalise
from logharrow.operators.pin import pin

# 0-based field positions of a TRAFFIC record.
POSITIONS = {
    "type": 3, "event_type": 4, "generated": 6, "src_ip": 7, "dst_ip": 8, "rule": 11,
    "application": 14, "src_zone": 16, "dst_zone": 17, "src_port": 24, "dst_port": 25,
    "protocol": 29, "action": 30, "bytes": 31,
}
MIN_FIELDS = 32
TIME = "yyyy/M/d H:m:s"


def split_quoted(df: DataFrame, line: str, name: str) -> DataFrame:
    """Add column ``name``: ``line`` split on commas outside quotes.

    Quotes toggle, a doubled one inside quotes is literal. Cutting at every quote
    leaves pieces alternately outside and inside quotes: commas inside are masked,
    and an empty piece between two quotes stands for a doubled quote. The mask is a control
    character and ``1``; that character itself is written with a ``0`` behind it meanwhile,
    so any text comes back as it was. Work is linear in the line, also for
    unbalanced quotes.
    """
    text, pieces = F.col(line), F.col("_pieces")
    mark, mask, own = F.lit("\u0001"), F.lit("\u00011"), F.lit("\u00010")
    quoted = F.contains(text, F.lit('"'))
    df = pin(df, _pieces=F.when(quoted, F.split(F.replace(text, mark, own), '"', -1)))
    df = pin(df, _last=F.size(pieces) - 1)

    def piece(part: Column, i: Column) -> Column:
        return (
            F.when(i % 2 == 1, F.replace(part, F.lit(","), mask))
            .when((part == "") & (i > 0) & (i < F.col("_last")), F.lit('"'))
            .otherwise(part)
        )

    masked = F.split(F.array_join(F.transform(pieces, piece), ""), ",", -1)
    unmasked = F.transform(masked, lambda field: F.replace(F.replace(field, mask, F.lit(",")), own, mark))
    fields = F.when(quoted, unmasked).otherwise(F.split(text, ",", -1))
    return pin(df, **{name: fields}).drop("_pieces", "_last")


def _usable(fields: Column) -> Column:
    return F.coalesce(
        (F.size(fields) >= MIN_FIELDS)
        & (F.upper(_field(fields, "type")) == "TRAFFIC")
        & (_field(fields, "src_ip") != ""),
        F.lit(False),
    )


def _field(fields: Column, name: str) -> Column:
    return strip(F.get(fields, F.lit(POSITIONS[name])))


def parse_panos(envelope: DataFrame) -> DataFrame:
    raw, tag, fields = F.col("raw"), F.col("tag"), F.col("_fields")
    rejoined = F.concat(tag, F.lit(" "), raw)
    first = F.col("_first")
    df = split_quoted(pin(envelope, _line=strip(raw)), "_line", "_first")
    df = pin(df, _whole=_usable(first))
    # The envelope may have taken the leading token for a tag: try with it back.
    df = pin(df, _joined=F.when(~F.col("_whole"), strip(rejoined)))
    df = split_quoted(df, "_joined", "_second")
    df = pin(df, _fields=F.when(F.col("_whole"), first).otherwise(F.col("_second")))

    def field(name: str) -> Column:
        return _field(fields, name)

    return normalise(
        df.withColumns({
            "parsed": _usable(fields),
            "ts": parse_naive_time(field("generated"), TIME),
            "action": F.when(F.lower(field("action")) == "allow", "allow").otherwise("deny"),
            "protocol": F.lower(field("protocol")),
            "src_ip": field("src_ip"),
            "src_port": to_number(field("src_port"), "int"),
            "dst_ip": field("dst_ip"),
            "dst_port": to_number(field("dst_port"), "int"),
            "src_zone": field("src_zone"),
            "dst_zone": field("dst_zone"),
            "rule": field("rule"),
            "bytes": to_number(field("bytes"), "bigint"),
            "event_type": field("event_type"),
            "application": field("application"),
            "raw": F.when(F.col("_whole") | tag.isNull(), raw).otherwise(rejoined),
        })
        .drop("_line", "_joined", "_first", "_second", "_whole", "_fields")
    )
