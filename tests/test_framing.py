"""Lines of pieces cut anywhere, from stored pieces and from a stream, against the whole text."""

import random
import time
from datetime import datetime, timedelta

import pytest

from logharrow.streaming import framing, live
from logharrow.streaming.framing import LINES, PIECES

NOW = datetime(2026, 6, 30, 12)
TEXTS = {
    "a": "one\ntwo\r\nthree\r\n\nünï😀\n" * 30, "b": "no newline at all", "c": "", "d": "\n", "e": "\r\n\r\nx\r", "f": "long " * 3000 + "\nend\n",
    None: "null connection\nrest",
}


def want(text):
    lines = text.encode().split(b"\n")
    if not lines[-1]:
        lines.pop()
    return [x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines]


def cut(seed, size):
    """All texts in pieces, mixed up; some pieces twice."""
    draw, rows = random.Random(seed), []
    for name, text in TEXTS.items():
        data, at, seq = text.encode(), 0, 0
        while at < len(data) or seq == 0:
            step = draw.randint(1, size)
            rows.append(("10.0.0.1", name, seq, data[at : at + step], NOW + timedelta(seconds=seq)))
            at, seq = at + step, seq + 1
    return rows + rows[::7]


def got(rows):
    found = {}
    for r in sorted(rows, key=lambda r: r.line):
        found.setdefault(r.connection, []).append(r.payload)
    return found


@pytest.mark.parametrize("seed, size", [(1, 4), (2, 60), (3, 5000)])
def test_stored_pieces(spark, seed, size):
    rows = cut(seed, size)
    lines = framing.lines_of(spark.createDataFrame(rows, PIECES).repartition(4))
    assert got(lines.collect()) == {k: want(t) for k, t in TEXTS.items() if want(t)}
    assert lines.schema.names == [c.split()[0] for c in LINES.split(", ")]
    first = lines.where("connection = 'b'").first()
    assert first.received_at == max(r[4] for r in rows if r[1] == "b")


def stream(spark, tmp_path, batches):
    (tmp_path / "in").mkdir()
    lines = framing.assemble(spark.readStream.schema(PIECES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), None)
    for batch in batches:
        spark.createDataFrame(batch, PIECES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live.start_table(lines, str(tmp_path / "table"), str(tmp_path / "checkpoint"), "append", {"availableNow": True}).awaitTermination()
    return live.read_table(spark, str(tmp_path / "table"), LINES).collect()


def test_a_stream_gives_the_same(spark, tmp_path):
    rows = cut(5, 400)
    random.Random(6).shuffle(rows)
    closing = [("10.0.0.1", name, 1 + max(r[2] for r in rows if r[1] == name), None, NOW) for name in TEXTS]
    found = stream(spark, tmp_path, [rows[: len(rows) // 2], rows[len(rows) // 2 :] + closing])
    assert got(found) == {k: want(t) for k, t in TEXTS.items() if want(t)}


def test_silence_gives_out_the_open_end(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = framing.assemble(spark.readStream.schema(PIECES).parquet(str(tmp_path / "in")), 2)
    spark.createDataFrame([("10.0.0.1", "q", 0, b"whole\nopen", NOW)], PIECES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    job = live.start_table(lines, str(tmp_path / "table"), str(tmp_path / "checkpoint"), "append", {"processingTime": "1 second"})
    found, end = [], time.monotonic() + 60
    try:
        while len(found) < 2 and time.monotonic() < end and job.isActive:
            time.sleep(1)
            found = live.read_table(spark, str(tmp_path / "table"), LINES).collect()
    finally:
        job.stop()
    assert sorted((r.line, r.payload) for r in found) == [(0, "whole"), (1, "open")]


def test_open_ends():
    held = framing.Open()
    held.add(0, b"a\nb", NOW)
    held.add(2, b"d\n", NOW)
    assert [r[1] for r in held.taken()] == ["a"]
    held.add(0, b"again\n", NOW)
    assert held.taken() == []
    assert [r[1] for r in held.flushed(0)] == ["bd"]  # the gap is closed up
    held = framing.Open()
    held.add(0, "é".encode()[:1], NOW)
    held.add(1, "é".encode()[1:] + b"\xff\r\nx", NOW)
    held.add(2, None, NOW)
    assert [r[1] for r in held.taken()] == ["é�", "x"] and held.closed


def test_lines_without_end_come_in_parts(monkeypatch):
    monkeypatch.setattr(framing, "LONGEST", 10)
    held = framing.Open()
    for seq in range(5):
        held.add(seq, b"abcdef", NOW)
    assert "".join(r[1] for r in [*held.taken(), *held.flushed(0)]) == "abcdef" * 5


def test_empty(spark):
    assert framing.lines_of(spark.createDataFrame([], PIECES)).count() == 0


def test_a_batch_of_appended_rows_is_computed_once(spark, tmp_path):
    from logharrow.streaming import live

    spark.range(40).selectExpr("cast(id AS string) AS value").repartition(2).write.parquet(str(tmp_path / "in"))
    seen = tmp_path / "seen"

    def count(frames):
        for frame in frames:
            with open(seen, "a") as out:
                out.write("x" * len(frame))
            yield frame

    rows = spark.readStream.schema("value string").parquet(str(tmp_path / "in")).mapInPandas(count, "value string")
    live.start_table(rows, str(tmp_path / "out"), str(tmp_path / "checkpoint"), "append", {"availableNow": True}).awaitTermination()
    assert live.read_table(spark, str(tmp_path / "out"), "value string").count() == 40
    assert len(seen.read_text()) == 40
