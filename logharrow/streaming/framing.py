"""Lines of byte streams that come in pieces, whatever the places at which they were cut.

A connection sends bytes; a piece is what one read brought. Lines end at newlines, a carriage
return before one is not part of it, and the open end of a closed connection is a line too. Bytes
become text only when a line is whole, so a character cut in two is none the worse.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

# What pieces look like: the place of a piece in its connection counts from 0; a NULL payload closes the connection.
PIECES = "peer_ip string, connection string, seq long, payload binary, received_at timestamp_ntz"
LINES = "peer_ip string, connection string, line long, payload string, received_at timestamp_ntz"
CONNECTION = ["peer_ip", "connection"]
# Bytes of the open end that are kept; a longer line is given out in parts of this size.
LONGEST = 1 << 20


def lines_of(pieces: DataFrame) -> DataFrame:
    """All lines of stored pieces: ``LINES``, numbered from 0 in each connection, NULL addresses included.

    A running count of newlines numbers the parts of each piece; only numbers are ranked by connection,
    and only the ends of pieces are brought together, so a long connection passes no task as a whole. A
    line is dated by its last piece. Connections need not be closed. Pieces delivered twice count once.
    """
    # One character per byte keeps bytes as they are while they are cut and joined.
    parts = F.split(F.coalesce(F.decode("payload", "ISO-8859-1"), F.lit("")), "\n", -1)
    numbered = pieces.dropDuplicates([*CONNECTION, "seq"]).select(*CONNECTION, "seq", "received_at", parts.alias("parts"))
    order = Window.partitionBy(*CONNECTION).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = numbered.select(*CONNECTION, "seq", (F.size("parts") - 1).cast("long").alias("ends"))
    before = before.select(*CONNECTION, "seq", F.coalesce(F.sum("ends").over(order), F.lit(0)).alias("before"))
    same = reduce_and([F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*CONNECTION, "seq"]])
    placed = numbered.alias("a").join(before.alias("b"), same).select("a.*", "b.before")
    each = placed.select(*CONNECTION, "seq", "received_at", "before", F.size("parts").alias("n"), F.posexplode("parts").alias("at", "part"))
    each = each.withColumn("line", F.col("before") + F.col("at"))
    inner = (F.col("at") > 0) & (F.col("at") < F.col("n") - 1)
    whole = each.where(inner).select(*CONNECTION, "line", "part", "received_at", F.lit(True).alias("ended"))
    ends = each.where(~inner).groupBy(*CONNECTION, "line").agg(
        F.array_sort(F.collect_list(F.struct("seq", "part", "received_at", (F.col("at") < F.col("n") - 1).alias("ended")))).alias("pieces")
    )
    joined = ends.select(
        *CONNECTION, "line", F.array_join("pieces.part", "").alias("part"), F.element_at("pieces.received_at", -1).alias("received_at"),
        F.exists("pieces.ended", lambda x: x).alias("ended"),
    )
    found = whole.unionByName(joined).where("ended OR part <> ''")
    return found.select(*CONNECTION, "line", _text(F.col("part")).alias("payload"), "received_at")


def reduce_and(tests: list[Column]) -> Column:
    found = tests[0]
    for test in tests[1:]:
        found = found & test
    return found


def _text(part: Column) -> Column:
    """A line of one character per byte as text, lossy; without the carriage return before its newline."""
    return F.make_valid_utf8(F.encode(F.regexp_replace(part, r"\r\z", ""), "ISO-8859-1").cast("string"))


def assemble(pieces: DataFrame, idle_seconds: int | None = 600) -> DataFrame:
    """The same of a stream of pieces, each line as soon as it is whole.

    The open end of a connection, and pieces that overtook others, are kept as state until what they
    wait for comes. A closed connection gives out its open end; one that is silent for ``idle_seconds``
    gives out what there is, missing pieces or not, and begins anew with its next piece. Of a
    connection a micro-batch is held in memory. Lines of more than LONGEST bytes come in parts.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else Open()
        if state.hasTimedOut:
            rows = held.flushed(state.getCurrentProcessingTimeMs())
            state.remove()
        else:
            for frame in frames:
                for seq, payload, at in zip(frame["seq"], frame["payload"], frame["received_at"]):
                    held.add(int(seq), payload, at)
            rows = held.taken()
            if held.closed:
                state.remove()
            else:
                state.update((pickle.dumps(held),))
                if idle_seconds is not None:
                    state.setTimeoutDuration(idle_seconds * 1000)
        if rows:
            line, payload, at = zip(*rows)
            yield pd.DataFrame({"peer_ip": key[0], "connection": key[1], "line": line, "payload": payload, "received_at": pd.to_datetime(list(at))})

    timeout = GroupStateTimeout.NoTimeout if idle_seconds is None else GroupStateTimeout.ProcessingTimeTimeout
    return pieces.groupBy(*CONNECTION).applyInPandasWithState(run, LINES, "held binary", "append", timeout)


class Open:
    """The open end of a connection."""

    def __init__(self):
        self.next, self.line, self.closed = 0, 0, False
        self.tail: list[bytes] = []
        self.at = None
        self.waiting: dict[int, tuple] = {}

    def add(self, seq: int, payload: bytes | None, at) -> None:
        if seq >= self.next:  # else it was delivered before
            self.waiting.setdefault(seq, (payload, at))

    def taken(self) -> list[tuple]:
        """Lines that are whole now."""
        rows = []
        while self.next in self.waiting and not self.closed:
            rows += self._take(*self.waiting.pop(self.next))
            self.next += 1
        return rows

    def flushed(self, now: int) -> list[tuple]:
        """All that there is, in order, with gaps closed up."""
        rows = []
        for seq in sorted(self.waiting):
            rows += self._take(*self.waiting[seq])
        return rows + self._end()

    def _take(self, payload: bytes | None, at) -> list[tuple]:
        if payload is None:
            self.closed = True
            return self._end()
        self.at = at
        first, *others = payload.split(b"\n")
        rows = []
        self.tail.append(first)
        for part in others:
            rows.append(self._line(b"".join(self.tail)))
            self.tail = [part]
        if sum(map(len, self.tail)) > LONGEST:
            whole = b"".join(self.tail)
            rows.append(self._line(whole[:LONGEST]))
            self.tail = [whole[LONGEST:]]
        return rows

    def _end(self) -> list[tuple]:
        rest = b"".join(self.tail)
        self.tail = []
        return [self._line(rest)] if rest else []

    def _line(self, data: bytes) -> tuple:
        self.line += 1
        return self.line - 1, data.removesuffix(b"\r").decode("utf-8", "replace"), self.at
