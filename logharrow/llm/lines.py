"""Line dedup within one edit, by a join of deletion neighbourhoods.

A line's neighbourhood is the line itself and what is left of it without one of its
characters. Two lines are within one edit exactly if one is the other without a
character, or both leave the same without the character at the same place (a changed
character). Keys of the second sort hold the place, so all lines of a key are within one
edit of each other and only the earliest of a key matters: nothing is paired.

Long lines have long neighbourhoods. Lines are therefore cut into four segments first, and
one key per segment stands for the line without it. A single edit lies in one segment, so lines
that share none of these keys with another line are out, and the rest emit only the
deletions within the segments they share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharrow.llm.blocks import PLACE_BITS, block_table, rids, unpack
from logharrow.llm.hashing import _BASE, _INVERSE, _STEP, _powers, mix
from logharrow.session import settled

U = np.uint64
SEGMENTS = 4
# Characters from which a line is compared within one edit, in production.
NEAR_FROM = 10
# Characters hashed at once; a longer line is hashed alone.
GROUP_CHARS = 1 << 19
BLANKS = " \t\n\x0b\x0c\r"
# Stands behind every id.
LAST = np.iinfo(np.int64).max
PLACE = ["o", "rid", "line"]


class Hashes:
    """Running sums of the characters of some lines, from which any part of a line is hashed."""

    def __init__(self, lines: list[str]):
        self.size = np.array(list(map(len, lines)), np.int64)
        self.start = np.cumsum(self.size) - self.size
        codes = np.frombuffer("".join(lines).encode("utf-32-le"), "<u4").astype(np.uint64)
        self.values = mix(codes + _STEP[60]) | U(1)
        self.power = _powers(_BASE, len(codes) + 1)
        self.back = _powers(_INVERSE, len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(self.values * self.power[:-1], out=self.sums[1:])

    def part(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Unmixed hashes of parts, given by places in the joined lines."""
        return (self.sums[stop] - self.sums[start]) * self.back[start]

    def whole(self) -> np.ndarray:
        return mix(self.part(self.start, self.start + self.size) + self.size.astype(np.uint64) * _STEP[59])

    def segments(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Number of the key, the lines that have it, and first and last place of the segment.

        A line of n characters is cut as one of n and as one of n + 1, of which it may
        have lost a character; keys of the two meet those of lines cut alike.
        """
        for longer in (0, 1):
            length = self.size + longer
            for j in range(SEGMENTS):
                a, b = j * length // SEGMENTS, (j + 1) * length // SEGMENTS
                has = np.flatnonzero(b > a)
                yield longer * SEGMENTS + j, has, a[has], b[has] - longer

    def coarse(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for number, has, a, b in self.segments():
            start, size = self.start[has], self.size[has]
            left, right = self.part(start, start + a), self.part(start + b, start + size)
            length = (size + number // SEGMENTS).astype(np.uint64)
            yield number, has, mix((left * _STEP[56] + mix(right + _STEP[55])) * _STEP[57] + length * U(SEGMENTS) + U(number % SEGMENTS))

    def without(self, line: int, places: np.ndarray) -> np.ndarray:
        """Hashes of a line without one character each, equal to ``whole`` of such a line."""
        start, stop = self.start[line], self.start[line] + self.size[line]
        at = start + places
        left = self.part(np.full(len(at), start), at)
        right = self.part(at + 1, np.full(len(at), stop))
        return mix(left + right * self.power[places] + (self.size[[line]] - 1).astype(np.uint64) * _STEP[59])


def worded(text: str) -> list[tuple[int, str]]:
    return [(i, line) for i, line in enumerate(text.split("\n")) if line.strip(BLANKS)]


def _texts(batch: pa.RecordBatch, i: int) -> tuple[int, list, list[str]]:
    block, ids, sizes = (batch.column(k)[i].as_py() for k in range(3))
    data, ends = unpack(batch.column(3)[i].as_py()), np.cumsum(sizes)
    return block, ids, [data[e - s : e].decode() for e, s in zip(ends, sizes)]


def _groups(rows: list[tuple[int, int, int, str]]) -> Iterator[list[tuple[int, int, int, str]]]:
    held, size = [], 0
    for row in rows:
        if held and size + len(row[3]) > GROUP_CHARS:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row[3])
    if held:
        yield held


def _lines(batch: pa.RecordBatch, i: int) -> list[tuple[int, int, int, str]]:
    """Lines with a word: order of the document's id, row number, line number, text."""
    block, ids, texts = _texts(batch, i)
    return [
        (LAST if key is None else key, int(rid), n, line)
        for key, rid, text in zip(ids, rids(block, len(ids)), texts)
        for n, line in worded(text)
    ]


def _identities(blocks: DataFrame) -> DataFrame:
    """A 128-bit identity of every line with a word, and its place; once per block at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for rows in _groups(_lines(batch, i)):
                    first: dict[str, tuple[int, int, int]] = {}
                    for o, rid, n, line in rows:
                        first[line] = min((o, rid, n), first.get(line, (o, rid, n)))
                    one = Hashes(list(first)).whole()
                    two = np.array([xxhash.xxh3_64_intdigest(line.encode()) for line in first], np.uint64)
                    places = np.array(list(first.values()), np.int64)
                    columns = [one.view(np.int64), two.view(np.int64), *places.T]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["h1", "h2", *PLACE])

    return blocks.mapInArrow(run, "h1 long, h2 long, o long, rid long, line long")


def _coarse_keys(blocks: DataFrame, near_from: int) -> DataFrame:
    """A key per segment of lines of ``near_from`` characters or more; ``tag`` is the line's identity with the key's number in its last bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for rows in _groups(_lines(batch, i)):
                    distinct = [line for line in {row[3]: None for row in rows} if len(line) >= near_from]
                    if not distinct:
                        continue
                    hashes = Hashes(distinct)
                    line = hashes.whole() & ~U(2 * SEGMENTS - 1)
                    keys, tags = [], []
                    for number, has, key in hashes.coarse():
                        keys.append(key)
                        tags.append(line[has] | U(number))
                    columns = [np.concatenate(c).view(np.int64) for c in (keys, tags)]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["key", "tag"])

    return blocks.mapInArrow(run, "key long, tag long")


def _met(keys: DataFrame) -> DataFrame:
    """Tags of keys that two different lines have; rows pass by in the order of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, several = None, None, False
        for batch in batches:
            out = []
            for key, tag in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != at:
                    at, first, several = key, tag, False
                elif several:
                    out.append(tag)
                elif tag // (2 * SEGMENTS) != first // (2 * SEGMENTS):
                    several = True
                    out += [first, tag]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["tag"])

    return keys.repartition("key").sortWithinPartitions("key", "tag").mapInArrow(run, "tag long").distinct()


def _asked(blocks: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """Blocks with the rows (rid, line and other columns) that ask for lines in them."""
    wanted = rows.groupBy(F.shiftright("rid", PLACE_BITS).alias("block"))
    return blocks.join(wanted.agg(F.collect_list(F.struct("rid", "line", *columns)).alias("asked")), "block")


def _line_of(texts: list[str], first: int) -> Callable[[int, int], str]:
    """The line of a row and number; a row's text is split once for all its lines asked for in turn."""
    held: list = [None, []]

    def line(rid: int, number: int) -> str:
        if held[0] != rid:
            held[:] = rid, texts[rid - first].split("\n")
        return held[1][number]

    return line


def _neighbourhoods(blocks: DataFrame, met: DataFrame) -> DataFrame:
    """Hashed keys of the lines in ``met`` (place, numbers of shared segments).

    ``at`` is 0 for a line as it is, 1 for it without some character, and the place of
    the character plus 2 for what a line with another character there would share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, _, texts = _texts(batch, i)
                line = _line_of(texts, int(rids(block, 1)[0]))
                for row in sorted(batch.column(4)[i].as_py(), key=lambda row: row["rid"]):
                    hashes = Hashes([line(row["rid"], row["line"])])
                    keys, kinds = [hashes.whole()], [np.zeros(1, np.int64)]
                    spans = {number: (int(a[0]), int(b[0])) for number, has, a, b in hashes.segments() if len(has)}
                    for number in sorted(set(row["numbers"])):
                        if number < SEGMENTS and number in spans:
                            places = np.arange(*spans[number])
                            left = hashes.without(0, places)
                            keys += [left, left]
                            kinds += [np.ones(len(places), np.int64), places + 2]
                    key, kind = np.concatenate(keys), np.concatenate(kinds)
                    # Deleting any of a run of equal characters leaves the same line.
                    _, once = np.unique(np.stack([key, kind.astype(np.uint64)]), axis=1, return_index=True)
                    n = len(once)
                    columns = [key[once].view(np.int64), kind[once], *(np.full(n, row[c], np.int64) for c in PLACE)]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["key", "at", *PLACE])

    return _asked(blocks, met, "o", "numbers").select("block", "ids", "sizes", "payload", "asked").mapInArrow(
        run, "key long, at long, o long, rid long, line long"
    )


def _earliest_partner(keys: DataFrame) -> DataFrame:
    """For each line with an earlier neighbour, its place and that of its earliest neighbour."""
    place = F.struct(*PLACE)
    keys = keys.select("key", "at", place.alias("place"))
    changed = keys.where("at >= 2").groupBy("key", "at").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    pairs = keys.join(changed.where("n > 1").drop("n"), ["key", "at"]).select("place", "first")
    ends = keys.where("at < 2").groupBy("key", "at").agg(F.min("place").alias("first"))
    # A line as it is meets lines without a character, and the other way round.
    other = ends.select("key", (1 - F.col("at")).alias("at"), "first")
    pairs = pairs.union(keys.join(other, ["key", "at"]).select("place", "first"))
    return pairs.where("first < place").groupBy("place").agg(F.min("first").alias("first"))


def within_one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[same + (len(a) >= len(b)) :] == b[same + (len(b) >= len(a)) :] or a == b


def _verified(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Places (rid, line) of the lines whose earlier partner is within one edit, by the texts."""
    one = pairs.select("place.rid", "place.line", F.col("place.rid").alias("to"), F.col("place.line").alias("at"))
    two = pairs.select("first.rid", "first.line", F.col("place.rid").alias("to"), F.col("place.line").alias("at"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, _, texts = _texts(batch, i)
                line = _line_of(texts, int(rids(block, 1)[0]))
                rows = sorted(batch.column(4)[i].as_py(), key=lambda row: row["rid"])
                lines = [line(r["rid"], r["line"]) for r in rows]
                columns = [pa.array([r[k] for r in rows], pa.int64()) for k in ("to", "at")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.string())], names=["to", "at", "text"])

    asked = _asked(blocks, one.union(two), "to", "at").select("block", "ids", "sizes", "payload", "asked")
    texts = asked.mapInArrow(fetch, "to long, at long, text string")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for to, at, text in zip(*(column.to_pylist() for column in batch.columns)):
                if held and held[:2] == (to, at):
                    if within_one_edit(held[2], text):
                        out.append((to, at))
                    held = None
                else:
                    held = (to, at, text)
            columns = list(zip(*out)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["rid", "line"])

    return texts.repartition("to", "at").sortWithinPartitions("to", "at").mapInArrow(compare, "rid long, line long")


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, near_from: int = 1
) -> DataFrame:
    """Removes every line equal to, or within one edit of, a line before it.

    The bound goes by length: lines of fewer than ``near_from`` characters (production: NEAR_FROM), for which one
    edit may be all the difference there is, as in years or headings, go for equal lines alone and
    make only equal lines go.

    Lines are what newlines separate; lines without a word stay and count for nothing. Order
    is by id (NULL last), then row and line; an edit inserts, deletes or changes one code point.
    A line goes also if the line before it that it resembles goes itself. Returns ``id_col``,
    n_lines, n_equal and n_near (removed lines), kept_sha256 and, with ``with_text``, clean_text;
    one row per row of ``docs``. NULL and empty texts have one line without a word. Repeated
    rows lose all their lines with words but in the first. Other columns are not read.
    """
    blocks = block_table(docs, id_col, text_col)
    firsts = _identities(blocks).groupBy("h1", "h2").agg(F.min(F.struct(*PLACE)).alias("first"))
    firsts = settled(firsts.select("h1", "first.*"), "lines")
    tag = F.col("tag")
    met = _met(_coarse_keys(blocks, near_from)).groupBy((tag - F.pmod(tag, F.lit(2 * SEGMENTS))).alias("name")).agg(
        F.collect_list(F.pmod(tag, F.lit(2 * SEGMENTS))).alias("numbers")
    )
    name = F.col("h1") - F.pmod("h1", F.lit(2 * SEGMENTS))
    met = firsts.withColumn("name", name).join(met, "name").select(*PLACE, "numbers")
    keys = settled(_neighbourhoods(blocks, settled(met, "met")), "neighbourhoods")
    near = _verified(blocks, settled(_earliest_partner(keys), "partners"))
    marked = firsts.join(near.withColumn("near", F.lit(True)), ["rid", "line"], "left")
    per_block = marked.groupBy(F.shiftright("rid", PLACE_BITS).alias("block")).agg(
        F.collect_list(F.struct("rid", "line", F.coalesce("near", F.lit(False)).alias("near"))).alias("lines")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, ids, texts = _texts(batch, i)
                known = {(r["rid"], r["line"]): r["near"] for r in batch.column(4)[i].as_py() or []}
                rows = []
                for key, rid, text in zip(ids, rids(block, len(ids)).tolist(), texts):
                    lines, equal, close = text.split("\n"), 0, 0
                    gone = set()
                    for n, _ in worded(text):
                        state = known.get((rid, n))
                        equal += state is None
                        close += state is True
                        if state is not False:
                            gone.add(n)
                    clean = "\n".join(line for n, line in enumerate(lines) if n not in gone)
                    row = [key, len(lines), equal, close, hashlib.sha256(clean.encode()).hexdigest()]
                    rows.append(row + [clean] * with_text)
                kinds = [pa.int64()] * 4 + [pa.string()] * (1 + with_text)
                names = ["id", "n_lines", "n_equal", "n_near", "kept_sha256", "clean_text"][: len(kinds)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    schema = "id long, n_lines long, n_equal long, n_near long, kept_sha256 string" + ", clean_text string" * with_text
    joined = blocks.join(per_block, "block", "left").select("block", "ids", "sizes", "payload", "lines")
    rows = joined.mapInArrow(run, schema)
    return rows.withColumnRenamed("id", id_col) if id_col != "id" else rows
