"""Which files can hold a text: filters of the trigrams in their search columns.

A filter is a row of bits for each stretch of a file that one task read; every trigram of its
lower-cased search columns, as bytes of UTF-8, sets a few of them. A search needs all trigrams
of its literal parts in one filter of a file, or the file is not opened. Filters may say yes
wrongly, never no; trigrams beyond ASCII are not asked for, so that case folding cannot differ.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logharrow import registry
from logharrow.sources import commits

# Bits of a filter, and how many of them a trigram sets. 100,000 distinct trigrams, more than a stretch of
# log lines tends to have, leave one in eleven of those never met undecided, and one in 1,000 of three together.
BITS = 1 << 19
HASHES = 2
# Smaller files have no filter: to read one is hardly dearer than to read its filter. A compaction gives them one.
LEAST_BYTES = 4 * BITS // 8
# Text looked at together in a task.
CHUNK_BYTES = 1 << 20
SCHEMA = "log_type string, day string, batch string, file string, bits array<long>"
_STEPS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def places(grams: np.ndarray) -> np.ndarray:
    """The bits of trigrams, given as 24-bit numbers."""
    shift = np.uint64(64 - (BITS - 1).bit_length())
    return np.concatenate([(grams.astype(np.uint64) + np.uint64(1)) * np.uint64(step) >> shift for step in _STEPS[:HASHES]]).astype(np.int64)


def trigrams(data: bytes) -> np.ndarray:
    """Distinct trigrams of a text as numbers; none spans a zero byte, which stands between columns."""
    return np.unique(_grams(np.frombuffer(data, np.uint8)))


def _grams(data: np.ndarray) -> np.ndarray:
    """Trigrams as they come, with repeats."""
    if len(data) < 3:
        return np.zeros(0, np.uint32)
    a = data.astype(np.uint32)
    whole = (a[:-2] > 0) & (a[1:-1] > 0) & (a[2:] > 0)
    return (a[:-2] << 16 | a[1:-1] << 8 | a[2:])[whole]


def _mark(bits: np.ndarray, texts: pa.Array, seen: np.ndarray | None = None) -> None:
    """Set the bits of all trigrams of texts that end with a zero byte each; their bytes are taken as they lie, one behind the other.

    ``seen`` has a place for every trigram, all false before and after: one met often is hashed once.
    """
    seen = np.zeros(1 << 24, bool) if seen is None else seen
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[texts.offset] : ends[texts.offset + len(texts)]]
    for at in range(0, len(data), CHUNK_BYTES):
        part = data[at : at + CHUNK_BYTES + 2].astype(np.uint32)  # those that begin in the chunk
        seen[part[:-2] << 16 | part[1:-1] << 8 | part[2:]] = True
    found = (np.flatnonzero(seen.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()  # looked through by eights
    found = found[seen[found]]
    seen[found] = False
    bits[places(found[(found >> 16 > 0) & (found >> 8 & 255 > 0) & (found & 255 > 0)])] = True


def pattern_trigrams(text: str) -> np.ndarray:
    """Trigrams that every text a search finds must hold: those of its parts between ``%`` and ``_``."""
    parts = [part for part in re.split("[%_]", text.lower())]
    grams = np.concatenate([np.zeros(0, np.uint32), *[trigrams(part.encode()) for part in parts]])
    return np.unique(grams[(grams & 0x808080) == 0])


def _lines(name: str) -> Column:
    """All search columns of a type in lower case, apart by zero bytes; what a search compares."""
    return F.concat_ws("\u0000", *[F.lower(F.col(c).cast("string")) for c in registry.get(name).report.search])


def write_filters(spark: SparkSession, root: str, portions: Iterable[commits.Portion]) -> list[commits.Portion]:
    """Store filters for the files of new folders, all in one job; the folders, marked as having them."""
    portions = list(portions)
    by_table: dict[str, list[commits.Portion]] = {}
    for p in portions:
        if p.counts and p.table in registry.REGISTRY and any(f.bytes >= LEAST_BYTES for f in p.files):
            by_table.setdefault(p.table, []).append(p)
    if not by_table:
        return portions
    frames = []
    for name, own in by_table.items():
        paths = [f"{root.rstrip('/')}/{p.folder}/{f.name}" for p in own for f in p.files if f.bytes >= LEAST_BYTES]
        rows = spark.read.schema(registry.get(name).schema).option("basePath", f"{root.rstrip('/')}/{name}").parquet(*paths)
        frames.append(rows.select(
            F.lit(name).alias("log_type"), F.col("_metadata.file_path").alias("path"), F.concat(_lines(name), F.lit("\u0000")).alias("text"),
        ))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bits, seen = None, np.zeros(BITS, bool), np.zeros(1 << 24, bool)

        def done() -> pa.RecordBatch:
            words = np.packbits(bits, bitorder="little").view(np.int64)
            keys = [held[0], *held[1].split("/")[-3:]]
            arrays = [pa.array([x], pa.string()) for x in keys] + [pa.array([words], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(arrays, names=["log_type", "day", "batch", "file", "bits"])

        for batch in batches:
            runs = [pc.run_end_encode(batch.column(k)).run_ends.to_numpy() for k in range(2)]
            begin = 0
            for end in np.unique(np.concatenate(runs)).tolist():  # where the rows of a file end
                key = tuple(batch.column(k)[begin].as_py() for k in range(2))
                if key != held:
                    if held is not None:
                        yield done()
                    held, bits[:] = key, False
                _mark(bits, batch.column(2).slice(begin, end - begin), seen)
                begin = end
        if held is not None:
            yield done()

    found = reduce(DataFrame.unionAll, frames).mapInArrow(build, SCHEMA)
    # The counts of a commit name the place of its filters.
    target = filters_path(next(p.counts for own in by_table.values() for p in own))
    found.write.parquet(f"{root.rstrip('/')}/{target}")
    having = {p.key for own in by_table.values() for p in own}
    return [commits.Portion(p.table, p.day, p.batch, p.files, p.counts, p.key in having) for p in portions]


def filters_path(counts: str) -> str:
    return counts.replace("/counts/", "/filters/")


def may_hold(spark: SparkSession, root: str, name: str, text: str, files: list[tuple[commits.Portion, commits.File]]):
    """Of some files of a type, those that can hold a row with the text; files without a filter can."""
    grams = pattern_trigrams(text)
    indexed = {filters_path(p.counts) for p, _ in files if p.indexed}
    if not len(grams) or not indexed:
        return files
    asked = np.unique(places(grams))
    tests = [F.getbit(F.element_at("bits", int(b) // 64 + 1), F.lit(int(b) % 64)) == 1 for b in asked]
    filters = spark.read.schema(SCHEMA).parquet(*[f"{root.rstrip('/')}/{path}" for path in sorted(indexed)])
    tested = filters.where(F.col("log_type") == name).groupBy("day", "batch", "file").agg(F.bool_or(reduce(lambda a, b: a & b, tests)).alias("hit"))
    out = {(r.day, r.batch, r.file) for r in tested.where("not hit").collect()}  # no more than there are files
    return [(p, f) for p, f in files if (p.day, p.batch, f.name) not in out]
