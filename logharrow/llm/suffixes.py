"""Removal of byte strings that an earlier document has, by expanding intervals on a BWT.

A string of 50 bytes has 35 windows of 16 bytes; the one of least hash is its anchor, of
tied ones the first. Equal strings have equal anchors, at equal places, so documents meet by
anchors alone. A string also has the 33 bytes that end with its anchor or those that begin
with it. Which of these at least two documents have is found first, by 28-bit tags, and only
the surroundings of their anchors, the bytes of all strings that have them, are compared.
Where these lie is stored; their bytes are taken from the texts when they are sent. Equal
surroundings are merged in their block and again where they meet; there a Burrows-Wheeler
transform of the distinct ones is walked, and gives for each 50-byte string the smallest
document that has it. The strings of anchors with very many different surroundings are dealt
out by their own hash instead.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view as windows
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharrow.llm.blocks import block_table, unpack
from logharrow.llm.hashing import sliding, window_hashes
from logharrow.session import settled

U = np.uint64
GRAM = 16
# Text whose anchors meet in one group, and text turned into one transform.
PART_BYTES = 32 << 20
TRANSFORM_BYTES = 1 << 18
# Different surroundings from which an anchor is hot: its strings are dealt out one by one.
HOT = 1 << 13
# Bytes looked through at a time are at most two pieces, so that their hashes stay in a core's cache.
PIECE = 1 << 15
# Bits of a window's hash that give way to its place among two pieces, so that of tied windows the first is least.
PLACE_BITS = U(22)
TAG_BITS = U(28)
# Bytes of surroundings, of one block or several, from which a task sends what it holds to the parts.
BUNDLE_BYTES = 16 << 20
# Surroundings or anchors handled at a time where each takes an index per byte.
ROWS = 1 << 12
# Stands behind every document: what has no id is earlier than none.
LAST = np.iinfo(np.int64).max
RUN = "part long, block long, payload binary"


def anchors(
    data: np.ndarray, sizes: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors in a block: places, ascending, where the strings they stand for start first and
    last, and hashes of the bytes before and behind them.

    A string has one anchor, of tied windows the first, so the choice depends on nothing but
    its bytes. Strings that start ``half`` before the anchor or earlier have all bytes of the
    first hash, the others all of the second; a hash is 0 if there is no such string.
    Documents, and pieces of long ones that share their ends, are taken together up to a
    bounded size; no string runs across two of them.
    """
    span = length - GRAM + 1
    half = span // 2
    places, firsts, lasts, before, behind = [], [], [], [], []
    ends = np.cumsum(sizes)
    group: list[tuple[int, int]] = []

    def flush() -> None:
        if not group:
            return
        part = np.concatenate([data[a:b] for a, b in group])
        size = np.array([b - a for a, b in group])
        origin = np.repeat(np.array([a for a, _ in group]) - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        end = np.repeat(np.cumsum(size), size)
        grams = window_hashes(part, GRAM)
        grams = grams >> PLACE_BITS << PLACE_BITS | np.arange(len(grams), dtype=U)
        least = sliding(grams, span, np.minimum)
        # A string that runs over the end of its document counts for nothing.
        start = np.flatnonzero(np.arange(len(least)) + length <= end[: len(least)])
        place = (least[start] & (U(1) << PLACE_BITS) - U(1)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(place)) + 1
        place, first, last = place[np.append(0, cuts)], start[np.append(0, cuts)], start[np.append(cuts, len(start)) - 1]
        wide = window_hashes(part, GRAM + half)
        has = first <= place - half
        left = np.zeros(len(place), U)
        left[has] = np.maximum(wide[place[has] - half], U(1))
        has = last > place - half
        right = np.zeros(len(place), U)
        right[has] = np.maximum(~wide[place[has]], U(1))
        places.append(place + origin[place])
        firsts.append(first + origin[place])
        lasts.append(last + origin[place])
        before.append(left)
        behind.append(right)
        group.clear()

    held = 0
    for start, stop in zip(ends - sizes, ends):
        for a in range(int(start), max(int(stop) - length + 1, int(start)), PIECE):
            b = min(int(stop), a + PIECE + length - 1)
            if held + b - a > 2 * PIECE:
                flush()
                held = 0
            group.append((a, b))
            held += b - a
    flush()
    if not places:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, U), np.zeros(0, U)
    place, back = np.unique(np.concatenate(places), return_inverse=True)
    first, last = np.full(len(place), LAST), np.full(len(place), -1)
    left, right = np.zeros(len(place), U), np.zeros(len(place), U)
    np.minimum.at(first, back, np.concatenate(firsts))
    np.maximum.at(last, back, np.concatenate(lasts))
    np.maximum.at(left, back, np.concatenate(before))
    np.maximum.at(right, back, np.concatenate(behind))
    return place, first, last, left, right


def hashes_at(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The hashes of the anchors at these places."""
    out = np.zeros(len(places), U)
    for k in range(0, len(places), ROWS):
        out[k : k + ROWS] = window_hashes(windows(data, GRAM)[places[k : k + ROWS]].ravel(), GRAM)[::GRAM]
    return out


def slices(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of an array, one behind the other."""
    out = [data[:0]]
    for k in range(0, len(starts), ROWS):
        size = sizes[k : k + ROWS]
        out.append(data[np.arange(size.sum()) + np.repeat(starts[k : k + ROWS] - (np.cumsum(size) - size), size)])
    return np.concatenate(out)


def home(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The part an anchor belongs to, and its tag there."""
    return ((hashes >> U(32)) % U(parts)).astype(np.int64), (hashes & (U(1) << TAG_BITS) - U(1)).astype(np.uint32)


def planes(values: np.ndarray) -> np.ndarray:
    """The steps between numbers, their first bytes one behind the other, then their second ones, and so on: these compress."""
    bits = values.itemsize * 8
    step = np.diff(values, prepend=values.dtype.type(0)).view(f"i{values.itemsize}")
    return ((step << 1) ^ (step >> (bits - 1))).view(np.uint8).reshape(-1, values.itemsize).T


def from_planes(data: np.ndarray, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    code = np.ascontiguousarray(data.reshape(size, -1).T).view(f"u{size}").ravel()
    return np.cumsum((code >> 1) ^ -(code & 1), dtype=f"u{size}").view(kind)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of known types, one behind the other, compressed."""
    raw = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(3).compress(struct.pack(f"<I{len(raw)}Q", len(raw), *map(len, raw)) + b"".join(raw))


def unpacked(data: bytes, *types) -> list[np.ndarray]:
    raw = unpack(data)
    n = struct.unpack_from("<I", raw)[0]
    lengths = struct.unpack_from(f"<{n}Q", raw, 4)
    at, out = 4 + 8 * n, []
    for length, kind in zip(lengths, types):
        out.append(np.frombuffer(raw, kind, length // np.dtype(kind).itemsize, at))
        at += length
    return out


def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    parts, blocks, payloads = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(parts, pa.int64()), pa.array(blocks, pa.int64()), pa.array(payloads, pa.binary())],
        names=["part", "block", "payload"],
    )


def by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Indexes of each part, ascending."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for rows in np.split(order, cuts) if len(order) else []:
        yield int(part[rows[0]]), rows


def _tags(blocks: DataFrame, parts: int, length: int) -> DataFrame:
    """Per block and part the distinct tags of bytes around anchors, and whether two of the block's documents have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sizes = np.array(batch.column(2)[i].as_py(), np.int64)
                data = np.frombuffer(unpack(batch.column(3)[i].as_py()), np.uint8)
                place, _, _, left, right = anchors(data, sizes, length)
                doc = np.searchsorted(np.cumsum(sizes), place, "right")
                part, tag = home(np.concatenate([left[left > 0], right[right > 0]]), parts)
                doc = np.concatenate([doc[left > 0], doc[right > 0]])
                key = part << np.int64(TAG_BITS) | tag
                order = np.argsort(key)
                key, doc = key[order], doc[order]
                starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                several = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts) if len(key) else np.zeros(0, bool)
                tag = tag[order][starts]
                block = batch.column(0)[i].as_py()
                yield batch_of([(p, block, packed(planes(tag[at]), several[at])) for p, at in by_part(part[order][starts])])

    return blocks.mapInArrow(run, RUN)


def _shared_tags(tags: DataFrame) -> DataFrame:
    """Per block and part, the tags that two documents have."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, lists, several = [], [], []
        for batch in batches:
            for block, payload in zip(batch.column(1), batch.column(2)):
                tag, twice = unpacked(payload.as_py(), np.uint8, bool)
                tag = from_planes(tag, np.uint32)
                blocks.append(block.as_py())
                lists.append(tag)
                several.append(tag[twice])
        every = np.sort(np.concatenate(lists))
        shared = np.union1d(every[1:][every[1:] == every[:-1]], np.concatenate(several))
        rows = []
        for block, tag in zip(blocks, lists):
            kept = tag[_among(tag, shared)]
            if len(kept):
                rows.append((key[0].as_py(), block, packed(planes(kept))))
        yield batch_of(rows)

    return tags.groupBy("part").applyInArrow(run, RUN)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values the ascending ones have."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _lying(blocks: DataFrame, shared: DataFrame, parts: int, length: int) -> DataFrame:
    """Where the surroundings of shared anchors lie in a block, and which are equal.

    As part -1 the start and length of each occurrence, the place of the anchor in it, and
    which of the block's distinct surroundings, numbered as they come, it is. As part -2
    the anchors with several distinct ones in the block, and how many.
    """
    lists = shared.groupBy("block").agg(F.collect_list(F.struct("part", "payload")).alias("shared"))
    half = (length - GRAM + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, sizes = (batch.column(k)[i].as_py() for k in range(2))
                text = unpack(batch.column(2)[i].as_py())
                data = np.frombuffer(text, np.uint8)
                place, start, last, left, right = anchors(data, np.array(sizes, np.int64), length)
                known = {row["part"]: from_planes(unpacked(row["payload"], np.uint8)[0], np.uint32) for row in batch.column(3)[i].as_py()}
                wanted = []
                for hashes in (left, right):
                    part, tag = home(hashes, parts)
                    has = np.zeros(len(place), bool)
                    for p, at in by_part(part):
                        if p in known:
                            has[at] = _among(tag[at], known[p])
                    wanted.append(has & (hashes > 0))
                # Strings whose bytes on that side no other document has are left out.
                start = np.where(wanted[0], start, np.maximum(start, place - half + 1))
                last = np.where(wanted[1], last, np.minimum(last, place - half))
                kept = wanted[0] | wanted[1]
                place, start, stop = place[kept], start[kept], last[kept] + length
                seen: dict[tuple[bytes, int], int] = {}
                number = np.array(
                    [seen.setdefault((text[s:e], a - s), len(seen)) for a, s, e in zip(place.tolist(), start.tolist(), stop.tolist())],
                    np.int32,
                )
                new = np.diff(np.maximum.accumulate(number), prepend=-1) > 0
                hashes, n = np.unique(hashes_at(data, place[new]), return_counts=True)
                yield batch_of([
                    (-1, block, packed(
                        planes(start), (stop - start).astype(np.uint8), (place - start).astype(np.uint8),
                        planes(np.where(new, 0, np.cumsum(new) - number).astype(np.int32)),
                    )),
                    (-2, block, packed(hashes[n > 1], n[n > 1].astype(np.int64))),
                ])

    return blocks.join(lists, "block").select("block", "sizes", "payload", "shared").mapInArrow(run, RUN)


def places(lies: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths, places of anchors and numbers of the occurrences of a block."""
    start, size, offset, number = unpacked(lies, np.uint8, np.uint8, np.uint8, np.uint8)
    start, back = from_planes(start, np.int64), from_planes(number, np.int32)
    return start, size.astype(np.int64), offset.astype(np.int64), np.cumsum(back == 0) - np.maximum(back, 1)


def firsts(number: np.ndarray) -> np.ndarray:
    """The first occurrence of each number."""
    return np.flatnonzero(np.diff(np.maximum.accumulate(number), prepend=-1))


def owners(ids: list, sizes: list, starts: np.ndarray) -> np.ndarray:
    """The documents of places in a block."""
    return np.array([LAST if x is None else x for x in ids], np.int64)[np.searchsorted(np.cumsum(np.array(sizes, np.int64)), starts, "right")]


def earliest(number: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The smallest document of each number."""
    low = np.full(number.max(initial=-1) + 1, LAST)
    np.minimum.at(low, number, docs)
    return low


def _surroundings(blocks: DataFrame, where: DataFrame, hot: np.ndarray, parts: int) -> DataFrame:
    """Distinct surroundings of shared anchors per part, of a block or several; those of hot anchors are left out.

    A payload has the blocks, how many surroundings are of each, and per surrounding the place
    of the anchor in it, length, smallest document, and the bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def bundle() -> pa.RecordBatch:
            part, block, offset, size, low, bodies = map(np.concatenate, zip(*held))
            begin = np.cumsum(size) - size
            rows = []
            for p, at in by_part(part):
                change = np.flatnonzero(np.concatenate([[True], np.diff(block[at]) != 0]))
                rows.append((p, -1, packed(
                    block[at][change], np.diff(np.append(change, len(at))), offset[at].astype(np.uint8),
                    size[at].astype(np.uint8), planes(low[at]), slices(bodies, begin[at], size[at]),
                )))
            held.clear()
            return batch_of(rows)

        for batch in batches:
            for i in range(batch.num_rows):
                block, ids, sizes = (batch.column(k)[i].as_py() for k in range(3))
                data = np.frombuffer(unpack(batch.column(3)[i].as_py()), np.uint8)
                start, size, offset, number = places(batch.column(4)[i].as_py())
                first = firsts(number)
                hashes = hashes_at(data, (start + offset)[first])
                warm = ~_among(hashes, hot)
                if not warm.any():
                    continue
                low = earliest(number, owners(ids, sizes, start))[warm]
                start, size, offset = (x[first[warm]] for x in (start, size, offset))
                part, _ = home(hashes[warm], parts)
                held.append((part, np.full(len(part), block), offset, size, low, slices(data, start, size)))
                if sum(len(x[-1]) for x in held) >= BUNDLE_BYTES:
                    yield bundle()
        if held:
            yield bundle()

    return blocks.join(where, "block").select("block", "ids", "sizes", "payload", "lies").mapInArrow(run, RUN)


def surroundings_of(payload: bytes) -> tuple[np.ndarray, ...]:
    """Blocks, how many surroundings each has, hashes and places of anchors, lengths, smallest documents, and the bytes."""
    blocks, counts, offset, size, low, joined = unpacked(payload, np.int64, np.int64, np.uint8, np.uint8, np.uint8, np.uint8)
    size = size.astype(np.int64)
    return blocks, counts, hashes_at(joined, np.cumsum(size) - size + offset), offset, size, from_planes(low, np.int64), joined


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of all rotations, sorted by their first 64 bytes, by doubling from eight."""
    n = len(text)
    around = np.concatenate([text, np.resize(text, 8)]).astype(np.uint64)
    rank = np.zeros(n, np.uint64)
    for k in range(8):
        rank = rank << U(8) | around[k : n + k]
    for width in (8, 16, 32, 64):
        order = np.argsort(rank)  # rows that agree in 64 bytes may stand in any order
        ranked = rank[order]
        place = np.zeros(n, np.int64)
        place[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
        if width < 64:
            rank = (place * n + np.roll(place, -width % n)).astype(np.uint64)
    return order


def prefix_edges(transform: np.ndarray, depth: int) -> np.ndarray:
    """Where neighbours in suffix order first differ within ``depth`` bytes, from the transform alone.

    Starting with the interval of the empty string, all intervals of one level are
    extended backwards by every byte they are preceded by. An extension whose end is not
    marked yet shows that the common prefix there is as long as the level; it is marked, and
    goes on to the next level. Others bring nothing new. Levels end at ``depth``: what is not
    marked then has a common prefix of that length at least.
    """
    n = len(transform)
    order = np.argsort(transform, kind="stable")
    back = np.empty(n, np.int64)  # the row of the string with the byte before it put in front
    back[order] = np.arange(n)
    same = np.concatenate([transform[order][1:] == transform[order][:-1], [False]])
    following = np.where(same, np.append(order[1:], 0), n)[back]  # the next row with the same byte
    preceding = np.where(np.concatenate([[False], same[:-1]]), np.append([0], order[:-1]), -1)[back]
    edge = np.zeros(n + 1, bool)
    edge[n] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(depth):
        if not len(low):
            break
        width = high - low
        rows = np.arange(width.sum()) + np.repeat(low - np.concatenate([[0], np.cumsum(width)[:-1]]), width)
        starts = np.sort(back[rows[preceding[rows] < np.repeat(low, width)]])
        stops = np.sort(back[rows[following[rows] >= np.repeat(high, width)]]) + 1
        new = ~edge[stops]
        edge[stops[new]] = True
        low, high = starts[new], stops[new]
    edge[0] = True
    return edge[:n]


def earlier_strings(text: np.ndarray, sizes: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """Per surrounding a bit for each string in it that one of an earlier document equals."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    start = np.cumsum(sizes) - sizes
    order = suffix_order(text)
    edge = prefix_edges(text[order - 1], length)
    whole = order + length <= (start + sizes)[owner[order]]
    doc = np.where(whole, docs[owner[order]], LAST)
    group = np.cumsum(edge) - 1
    least = np.minimum.reduceat(doc, np.flatnonzero(edge))[group]
    hit = order[whole & (least < doc)]
    bits = np.zeros(len(sizes), np.uint64)
    np.bitwise_or.at(bits, owner[hit], U(1) << (hit - start[owner[hit]]).astype(np.uint64))
    return bits


def _hot_anchors(lying: DataFrame) -> tuple[np.ndarray, int]:
    """Anchors with over ``HOT`` surroundings, ascending, and the number of those.

    Surroundings are counted per block; where a block has only one of an anchor it is left
    out of the count, so an anchor that is not hot has at most one a block more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0):
                columns = unpacked(payload.as_py(), np.int64, np.int64)
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["anchor", "n"])

    counts = lying.where("part = -2").select("payload").mapInArrow(run, "anchor long, n long")
    # Few by definition: each stands for over HOT surroundings.
    found = counts.groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > HOT).collect()
    return np.sort(np.array([r.anchor for r in found], np.int64).view(U)), sum(r.n for r in found)


def _hot_strings(blocks: DataFrame, where: DataFrame, hot: np.ndarray, parts: int, length: int) -> DataFrame:
    """The single strings of hot anchors, dealt out by their hash.

    ``part`` is where a string is dealt to; a payload has, per string: the block, the number of
    the surrounding there, the string's place in it, its document, and the bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def bundle() -> pa.RecordBatch:
            to, block, number, place, low, bodies = map(np.concatenate, zip(*held))
            held.clear()
            return batch_of([
                (p, -1, packed(planes(block[at]), planes(number[at]), place[at], planes(low[at]), bodies[at])) for p, at in by_part(to)
            ])

        for batch in batches:
            for i in range(batch.num_rows):
                block, ids, sizes = (batch.column(k)[i].as_py() for k in range(3))
                data = np.frombuffer(unpack(batch.column(3)[i].as_py()), np.uint8)
                start, size, offset, number = places(batch.column(4)[i].as_py())
                first = firsts(number)
                index = np.flatnonzero(_among(hashes_at(data, (start + offset)[first]), hot))
                if not len(index):
                    continue
                low = earliest(number, owners(ids, sizes, start))[index]
                each = size[first[index]] - length + 1
                place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                begin = np.repeat(start[first[index]], each) + place
                bodies = windows(data, length)[begin]
                to = [window_hashes(bodies[k : k + ROWS].ravel(), length)[::length] for k in range(0, len(bodies), ROWS)]
                to = (np.concatenate(to) % U(parts)).astype(np.int64)
                held.append((to, np.full(len(to), block), np.repeat(index, each).astype(np.int32), place.astype(np.uint8), np.repeat(low, each), bodies))
                if sum(x[-1].size for x in held) >= BUNDLE_BYTES:
                    yield bundle()
        if held:
            yield bundle()

    return blocks.join(where, "block").select("block", "ids", "sizes", "payload", "lies").mapInArrow(run, RUN)


def _hot_answers(strings: DataFrame, length: int) -> DataFrame:
    """Per block, as part -1: which strings of which surroundings an earlier document has."""

    def read(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
        block, number, place, docs, bodies = unpacked(payload, np.uint8, np.uint8, np.uint8, np.uint8, np.uint8)
        return from_planes(block, np.int64), from_planes(number, np.int32), place, from_planes(docs, np.int64), bodies.tobytes()

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[bytes, int] = {}
        held = []
        for batch in batches:
            for payload in batch.column(2).to_pylist():
                *_, docs, raw = read(payload)
                for i, d in enumerate(docs.tolist()):
                    body = raw[i * length : (i + 1) * length]
                    if d < low.setdefault(body, d):
                        low[body] = d
                held.append(payload)
        rows = []
        for payload in held:
            block, number, place, docs, raw = read(payload)
            least = np.array([low[raw[i * length : (i + 1) * length]] for i in range(len(docs))], np.int64)
            hit = least < docs
            for b, at in by_part(block[hit]):
                rows.append((-1, b, packed(number[hit][at], place[hit][at])))
        yield batch_of(rows)

    return strings.groupBy("part").applyInArrow(run, RUN)


def _answers(surroundings: DataFrame, length: int) -> DataFrame:
    """Per block and part: for each of its surroundings the smallest document, and the bits."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[bytes, int], int] = {}
        anchor: list[int] = []
        low: list[int] = []
        parted, numbers = [], []
        for batch in batches:
            for payload in batch.column(2):
                blocks, counts, hashes, offset, size, docs, joined = surroundings_of(payload.as_py())
                stop = np.cumsum(size).tolist()
                raw, number, s = joined.tobytes(), [], 0
                for h, o, e, d in zip(hashes.tolist(), offset.tolist(), stop, docs.tolist()):
                    k = seen.setdefault((raw[s:e], o), len(low))
                    if k == len(low):
                        anchor.append(h)
                        low.append(d)
                    elif d < low[k]:
                        low[k] = d
                    number.append(k)
                    s = e
                parted.append((blocks.tolist(), np.cumsum(counts).tolist()))
                numbers.append(np.array(number, np.int64))
        bodies = [body for body, _ in seen]
        seen.clear()
        least, bits = np.array(low, np.int64), np.zeros(len(low), np.uint64)
        # Only anchors with different surroundings have anything to compare.
        for some in _portions(np.array(anchor, np.uint64), np.array(list(map(len, bodies)), np.int64)):
            text = np.frombuffer(b"".join(bodies[k] for k in some), np.uint8)
            bits[some] = earlier_strings(text, np.array([len(bodies[k]) for k in some]), least[some], length)
        rows = []
        for (blocks, cuts), k in zip(parted, numbers):
            for block, a, b in zip(blocks, [0, *cuts], cuts):
                rows.append((key[0].as_py(), block, packed(least[k[a:b]], bits[k[a:b]])))
        yield batch_of(rows)

    return surroundings.groupBy("part").applyInArrow(run, RUN)


def _portions(anchor: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Surroundings in portions of bounded size, those of one anchor always together."""
    order = np.argsort(anchor, kind="stable")
    cuts = np.flatnonzero(np.diff(anchor[order])) + 1
    held: list[np.ndarray] = []
    size = 0
    for rows in np.split(order, cuts) if len(order) else []:
        if len(rows) < 2:
            continue
        if held and size + sizes[rows].sum() > TRANSFORM_BYTES:
            yield np.concatenate(held)
            held, size = [], 0
        held.append(rows)
        size += sizes[rows].sum()
    if held:
        yield np.concatenate(held)


def repeated_bytes(
    docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True
) -> DataFrame:
    """Removes each byte covered by a string of ``length`` bytes that also starts in a smaller id.

    Returns ``id_col``, n_bytes, n_removed, n_spans, kept_sha256 and, with ``with_text``,
    kept (the remaining bytes) and spans (start and end of what was removed); one row per row of
    ``docs``. NULL and empty texts have no bytes. Rows of the same id remove nothing from each
    other; a NULL id is behind all others, and removes nothing from another. Strings are
    judged on the input. Columns other than the two named are not read.
    """
    if not GRAM < length <= 64:
        raise ValueError(f"the length must be over {GRAM} and at most 64")
    blocks = block_table(docs, id_col, text_col)
    total = blocks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    parts = max(1, -(-total // PART_BYTES))
    shared = settled(_shared_tags(_tags(blocks, parts, length)), "tags")
    lying = settled(_lying(blocks, shared, parts, length), "surroundings")
    hot, n_hot = _hot_anchors(lying)
    where = lying.where("part = -1").select("block", F.col("payload").alias("lies"))
    answers = _answers(_surroundings(blocks, where, hot, parts), length)
    if len(hot):
        hot_parts = max(1, -(-n_hot * (length - GRAM + 1) * length // PART_BYTES))
        answers = answers.union(_hot_answers(_hot_strings(blocks, where, hot, hot_parts, length), length))
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("part", "payload")).alias("answers"))
    joined = blocks.join(where.join(answers, "block", "left"), "block", "left")
    span = length - GRAM + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, sizes, payload, lies, given = (batch.column(k)[i].as_py() for k in range(5))
                text = np.frombuffer(unpack(payload), np.uint8)
                goes = np.zeros(len(text) + 1, np.int32)
                if lies:
                    start, size, offset, number = places(lies)
                    first = firsts(number)
                    own = owners(ids, sizes, start)
                    least, bits = earliest(number, own), np.zeros(len(first), U)
                    hashes = hashes_at(text, (start + offset)[first])
                    warm = np.flatnonzero(~_among(hashes, hot))
                    found = {row["part"]: unpacked(row["payload"], np.int64, U) for row in given or () if row["part"] >= 0}
                    for p, at in by_part(home(hashes[warm], parts)[0]):
                        least[warm[at]], bits[warm[at]] = found[p]
                    for row in given or ():
                        if row["part"] < 0:
                            n, k = unpacked(row["payload"], np.int32, np.uint8)
                            np.bitwise_or.at(bits, n, U(1) << k.astype(U))
                    least, bits = least[number], bits[number]
                    later = own > least
                    np.add.at(goes, start[later], 1)
                    np.add.at(goes, start[later] + size[later], -1)
                    for k in range(span):
                        hit = start[~later & (bits >> U(k) & U(1) > 0)] + k
                        np.add.at(goes, hit, 1)
                        np.add.at(goes, hit + length, -1)
                gone = np.cumsum(goes[:-1]) > 0
                yield _documents(ids, sizes, text, gone, with_text)

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", kept binary, spans array<struct<start:long,end:long>>" * with_text
    rows = joined.select("ids", "sizes", "payload", "lies", "answers").mapInArrow(run, schema)
    return rows.withColumnRenamed("id", id_col) if id_col != "id" else rows


def _documents(ids: list, sizes: list, text: np.ndarray, gone: np.ndarray, with_text: bool) -> pa.RecordBatch:
    rows, at = [], 0
    for key, size in zip(ids, sizes):
        mask = gone[at : at + size]
        kept = text[at : at + size][~mask].tobytes()
        edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
        row = {"id": key, "n_bytes": size, "n_removed": int(mask.sum()), "n_spans": len(edges) // 2, "kept_sha256": hashlib.sha256(kept).hexdigest()}
        if with_text:
            row |= {"kept": kept, "spans": [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]}
        rows.append(row)
        at += size
    fields = [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    if with_text:
        fields += [("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))
