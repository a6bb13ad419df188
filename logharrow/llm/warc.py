"""WARC archives: a writer of one gzip member per record, and a splittable reader."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of an archive that one task owns, and what it reads at a time.
SPLIT_BYTES = 16 << 20
CHUNK = 1 << 16
# Tasks that read at most; with more ranges each reads several.
MOST_TASKS = 20_000
# Equal payloads of at least so many bytes are stored once.
MIN_REVISIT = 100
MAGIC = b"\x1f\x8b\x08"
URN = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "record_id string, record_type string, target_uri string, refers_to_id string, payload_digest string, "
    "payload_bytes long, payload binary, file string, position long"
)


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path that Spark gave, and the path in it."""
    if path.startswith("file:/"):
        path = "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path)


def with_revisits(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pages with payload, digest, and the page that a page with an equal payload refers to.

    Only digests met more than once go into the table that pages look up; a digest
    of very many pages is a skewed key of a join, which Spark splits.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.col("url").alias("url") if "url" in pages.columns else F.lit(None).cast("string").alias("url"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    long = rows.where(F.octet_length("payload") >= MIN_REVISIT)
    many = long.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    joined = rows.join(many.select("digest", "first"), "digest", "left")
    refers = F.when(F.col("id").isNull() | (F.col("id") > F.col("first")), F.col("first"))
    return joined.select("id", "url", "payload", "digest", refers.alias("refers_to"))


def header(fields: list[tuple[str, str | None]]) -> bytes:
    """Header lines; a value's line breaks become blanks, absent values are left out."""
    lines = [f"{k}: {' '.join(v.splitlines())}\r\n" for k, v in fields if v is not None]
    return "".join(lines).encode() + b"\r\n"


def record(page: int | None, number: str, url: str | None, payload: bytes, digest: str, refers: int | None, date: str) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP header, with the full length, alone."""
    http = b"HTTP/1.1 200 OK\r\n" + header(
        [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    )
    block = http + (payload if refers is None else b"")
    name = f"<{URN}{page}>" if page is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, number)}>"
    head = b"WARC/1.1\r\n" + header([
        ("WARC-Type", "response" if refers is None else "revisit"),
        ("WARC-Record-ID", name),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Profile", None if refers is None else PROFILE),
        ("WARC-Refers-To", None if refers is None else f"<{URN}{refers}>"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ])
    gzip = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gzip.compress(head + block + b"\r\n\r\n") + gzip.flush()


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", text_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> int:
    """Writes one archive per task to ``folder``, which all executors reach; returns the records written.

    A task sorts its pages, writes under a name of its attempt and moves the file to its final
    name, so that a repeated or doubled task leaves one whole file. NULL payloads are empty;
    the same id twice with equal payloads gives two responses; no pages give an empty folder.
    """
    store, root = open_store(folder)
    store.create_dir(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, root = open_store(folder)
        name = f"part-{context.partitionId():05d}"
        draft, out, n = f"{root}/_{name}-{context.taskAttemptId()}", None, 0
        for batch in batches:
            for row in zip(*(column for column in batch.columns)):
                if out is None:
                    out = store.open_output_stream(draft, compression=None)
                page, url, payload, digest, refers = (v.as_py() for v in row)
                out.write(record(page, f"{name}/{n}", url, payload, digest, refers, date))
                n += 1
        if out is not None:
            out.close()
            try:
                store.move(draft, f"{root}/{name}.warc.gz")
            except OSError:
                # Some stores do not move onto a file: an earlier try of this task, with the same rows, got so far.
                if store.get_file_info(f"{root}/{name}.warc.gz").type != fs.FileType.File:
                    raise
                store.delete_file(draft)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    ready = with_revisits(pages, id_col, text_col).sortWithinPartitions("id", "digest", "url")
    return ready.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


class Member:
    """A gzip member decoded from a place in a file; ``end`` is where it stops, None if it is none."""

    def __init__(self, source, at: int, size: int):
        self.end, self.data = None, b""
        gzip, parts, place, made = zlib.decompressobj(31), [], at, 0
        try:
            while not gzip.eof and place < size:
                chunk = source.read_at(min(CHUNK, size - place), place)
                place += len(chunk)
                part = gzip.decompress(chunk)
                parts.append(part)
                made += len(part)
                if made >= 8 and not b"".join(parts[:2])[:7] == b"WARC/1.":
                    return
        except zlib.error:
            return
        if gzip.eof:
            self.end, self.data = place - len(gzip.unused_data), b"".join(parts)


def parsed(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields, lower-cased, and block of a record; None if it is not one."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/1."):
        return None
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    length = fields.get("content-length", "")
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        return None
    return fields, rest[:-4]


def _decoded(source, at: int, size: int) -> tuple[int, tuple[dict[str, str], bytes] | None]:
    """The end of the whole record at a place and what it says, or (0, None)."""
    member = Member(source, at, size)
    got = parsed(member.data) if member.end else None
    return (member.end, got) if got else (0, None)


def members(source, start: int, end: int, size: int) -> Iterator[tuple[int, int, dict[str, str] | None, bytes]]:
    """Records that start in [start, end), read to their ends: (place, length, fields, block).

    The first is searched by the gzip magic; a place counts if it decodes to a whole record
    with a good check sum that the file's end or another member follows. From there on
    each record starts where the one before ended. Where none is, bytes are damaged: that is
    told with fields None and the length up to the next record, and the search goes on. The record
    behind the range is decoded too, as only who read the one before knows where it must be; if
    damaged bytes follow it, it is told here.
    """
    at, sure, lost = start, start == 0, None
    while at < end or sure and at < size:
        if not sure:
            found = -1
            while at < end and found < 0:
                chunk = source.read_at(min(CHUNK, size - at), at)
                found = chunk.find(MAGIC)
                if found < 0:
                    at += max(len(chunk) - len(MAGIC) + 1, 1)
            at += max(found, 0)
            if found < 0 or at >= end:
                break
        stop, got = _decoded(source, at, size)
        followed = bool(got) and (stop == size or source.read_at(3, stop) == MAGIC)
        if sure and at >= end:
            if not got:
                lost = at
            elif not followed:
                # The range's own reader, put down there, could not tell it from a record within a payload.
                yield at, stop - at, *got
                lost = stop
            break
        if got and (sure or followed):
            if lost is not None:
                yield lost, at - lost, None, b""
                lost = None
            yield at, stop - at, *got
            at, sure = stop, True
        else:
            if sure:
                lost = at
            at, sure = at + 1, False
    if lost is not None:
        yield lost, max(end, lost + 1) - lost, None, b""


def read_warc(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES, damaged: str = "raise") -> DataFrame:
    """All records of the archives in a folder; a task reads one range of bytes, or a few.

    Files are listed by Spark and cut into ranges of ``split_bytes``, dealt out evenly over as
    many tasks, up to MOST_TASKS; every record belongs to the range it starts in, so each is read
    once whatever the cuts. Payload digest and length are computed for responses and taken from the
    headers for revisits; a response whose payload is not what its header says raises an error.
    Bytes that are no whole record, a cut-off last one among them, raise an error too, or with
    ``damaged="report"`` give a row of record_type ``damaged`` with their place and, as payload_bytes, how
    many were passed over in its range. A folder without archives gives no rows.
    """
    if damaged not in ("raise", "report"):
        raise ValueError(f"damaged must be raise or report, not {damaged}")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    ranges = files.where("length > 0").select(
        "path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                store, name = open_store(path)
                with store.open_input_file(name) as source:
                    rows, held = [], 0
                    for at, length, fields, block in members(source, start, min(start + split_bytes, size), size):
                        if fields is None and damaged == "raise":
                            raise ValueError(f"no whole record at {at} of {path}")
                        rows.append(damage_row(path, at, length) if fields is None else row_of(path, at, fields, block))
                        held += len(block)
                        if held > split_bytes:
                            yield as_batch(rows)
                            rows, held = [], 0
                    yield as_batch(rows)

    schema = spark.createDataFrame([], RECORD).schema
    # A number of its own, which adaptive execution leaves alone: a range is a few bytes here, but much to read.
    tasks = max(1, min(ranges.count(), MOST_TASKS))
    return ranges.repartition(tasks).mapInArrow(read, schema)


def damage_row(path: str, at: int, length: int) -> dict:
    return {
        "record_id": None, "record_type": "damaged", "target_uri": None, "refers_to_id": None, "payload_digest": None,
        "payload_bytes": length, "payload": None, "file": path, "position": at,
    }


def row_of(path: str, at: int, fields: dict[str, str], block: bytes) -> dict:
    kind = fields.get("warc-type")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "revisit":
        lengths = [v for k, _, v in (line.partition(b":") for line in http.split(b"\r\n")) if k.lower() == b"content-length"]
        size, payload = int(lengths[0]) if lengths else None, None
    else:
        size, own = len(payload), hashlib.sha256(payload).hexdigest()
        if digest and digest != own:
            raise ValueError(f"payload digest of the record at {at} of {path} does not hold")
        digest = own
    return {
        "record_id": fields.get("warc-record-id", "").strip("<>"), "record_type": kind,
        "target_uri": fields.get("warc-target-uri"), "refers_to_id": (fields.get("warc-refers-to") or "").strip("<>") or None,
        "payload_digest": digest, "payload_bytes": size, "payload": payload, "file": path, "position": at,
    }


def as_batch(rows: list[dict]) -> pa.RecordBatch:
    names = {"payload_bytes": pa.int64(), "payload": pa.binary(), "position": pa.int64()}
    wanted = [part.split()[0] for part in RECORD.split(", ")]
    schema = pa.schema([(name, names.get(name, pa.string())) for name in wanted])
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def page_records(records: DataFrame) -> DataFrame:
    """What the records say of each page: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    page = lambda c: F.when(F.startswith(c, F.lit(URN)), F.substring(c, len(URN) + 1, F.length(c))).cast("long")
    return records.select(
        page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page(F.col("refers_to_id")).alias("refers_to"),
    )
