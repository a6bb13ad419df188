"""Product codes of vectors: Lloyd's rounds over two trees, all in integers.

Vectors are cut into equal consecutive parts, and each part position has a codebook of its
own. Blocks of vectors are written once with a tree over each of their part positions: boxes and
sums of the parts under every node. A round puts a second tree over the codebook's entries
and walks both together: a pair of nodes is dropped where another entry is surely nearer to all the
parts of the box, a node left with one entry gives its cached sum to that entry as a whole, and
the leaves that stay uncertain compare their parts one by one. All bounds and distances are
exact integers, so the walk gives what comparing everything gives, ties included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharrow.operators.lookup import lookup_join
from logharrow.session import settled

# Vectors in a block, and the most parts a leaf of a tree holds.
BLOCK_ROWS = 4_096
LEAF_ROWS = 16
# Sums travel as digits of this many bits, so no table makes them overflow.
DIGIT_BITS = 32
MOST = 2**63 - 1


@dataclass(frozen=True)
class Lloyd:
    """``parts`` codebooks of ``entries`` entries, after ``rounds`` rounds on floor(scale * x)."""

    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4_096

    def __post_init__(self):
        if not (self.parts > 0 and 0 < self.entries <= 256 and self.rounds >= 0):
            raise ValueError("parts and entries must be positive, entries at most 256")


@dataclass(frozen=True)
class Layout:
    """How wide a part is, and whether its distances fit 64-bit integers."""

    width: int
    wide: bool  # Python's integers instead
    digits: int

    @property
    def kind(self):
        return object if self.wide else np.int64

    def dump(self, values: np.ndarray) -> bytes:
        return " ".join(map(str, values.ravel())).encode() if self.wide else values.astype(np.int64).tobytes()

    def load(self, data: bytes) -> np.ndarray:
        if not self.width:
            return np.zeros((0, 0), self.kind)
        if not self.wide:
            return np.frombuffer(data, np.int64).reshape(-1, self.width)
        flat = [int(x) for x in data.split()]
        return np.array(flat, object).reshape(-1, self.width)


def vector_codes(
    vectors: DataFrame, how: Lloyd = Lloyd(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """The code of every vector, with its error and that of its label.

    Returns ``id_col``, code (two hex digits for each part), error (squared distances to the
    codes' entries, summed), label_error (error summed over equal labels, NULLs together) and
    codebooks_sha256; one row per row of ``vectors`` whose vector is neither NULL nor holds
    NULL, infinite or NaN components. A codebook starts as the parts of the vectors of
    smallest id, NULL ids last and equal ids by their components; fewer vectors give fewer
    entries. Repeated rows are rows of their own. Vectors shorter than the longest, or of a
    length that cannot be cut evenly, count as followed by zeros. Errors stop at the largest
    64-bit integer. Only the codebooks and one vector per entry pass the driver.
    """
    value = F.col(vector_col).cast("array<double>")
    own = F.coalesce(F.concat(F.lit("="), F.col(label_col).cast("string")), F.lit(""))
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), own.alias("key"), value.alias("v")).where(
        F.col("v").isNotNull() & finite
    )
    layout = _layout(kept, how)
    first = [r.v for r in kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(how.entries).collect()]
    books = _cut(_integers(first, how, layout), how, layout)
    blocks = settled(_blocks(kept, how, layout), "vectors")
    for _ in range(how.rounds):
        books = _moved(books, _sums(blocks, books, layout))
    coded = settled(_coded(blocks, books, layout), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)"))
    totals = settled(coded.groupBy("key").agg(total.cast("long").alias("label_error")), "label-errors")
    text = ",".join(str(x) for book in books for x in book.ravel())
    digest = hashlib.sha256(text.encode()).hexdigest()
    return lookup_join(coded, totals, "key").select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


def _layout(kept: DataFrame, how: Lloyd) -> Layout:
    largest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    row = kept.agg(F.max(F.size("v")).alias("n"), F.max(largest).alias("x")).first()
    width = -(-(row.n or 0) // how.parts)
    bound = int(row.x or 0) * how.scale + how.scale
    # Bounds in the walk stay under 16 times width times the square of the largest value.
    wide = 16 * max(width, 1) * bound * bound >= 2**62
    return Layout(width, wide, (bound.bit_length() + 64) // DIGIT_BITS + 1)


def _integers(rows: list, how: Lloyd, layout: Layout) -> np.ndarray:
    """floor(scale * x) of every component, zeros behind short vectors."""
    out = np.zeros((len(rows), how.parts * layout.width), layout.kind)
    for i, row in enumerate(rows):
        if not layout.wide:
            out[i, : len(row)] = np.floor(np.array(row, np.float64) * how.scale)
            continue
        for j, x in enumerate(row):
            up, down = float(x).as_integer_ratio()
            out[i, j] = up * how.scale // down
    return out


def _cut(values: np.ndarray, how: Lloyd, layout: Layout) -> list[np.ndarray]:
    w = layout.width
    return [values[:, p * w : (p + 1) * w] for p in range(how.parts)]


# The tree over the parts of a block: level by level, each node cut in the middle of its
# widest direction. Bounds of the nodes follow from the number of parts alone.


def _depth(n: int) -> int:
    return max(0, (max(n, 1) - 1) // LEAF_ROWS).bit_length()


def _edges(n: int, level: int) -> np.ndarray:
    return np.arange((1 << level) + 1) * n >> level


def _tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of the parts, and least, greatest and summed components of all nodes, root first."""
    n, order = len(points), np.arange(len(points))
    low, high, total = [], [], []
    for level in range(_depth(n) + 1):
        edges = _edges(n, level)
        here = points[order]
        low.append(np.minimum.reduceat(here, edges[:-1]))
        high.append(np.maximum.reduceat(here, edges[:-1]))
        total.append(np.add.reduceat(here, edges[:-1]))
        if level < _depth(n) and points.shape[1]:
            node = np.repeat(np.arange(1 << level), np.diff(edges))
            widest = np.argmax(high[-1] - low[-1], axis=1)
            order = order[np.lexsort((here[np.arange(n), widest[node]], node))]
    return order, np.concatenate(low), np.concatenate(high), np.concatenate(total)


BLOCK = "ids array<long>, keys array<string>, orders array<binary>, points array<binary>, low array<binary>, high array<binary>, total array<binary>"


def _blocks(kept: DataFrame, how: Lloyd, layout: Layout) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                columns: list[list[bytes]] = [[] for _ in range(5)]
                for points in _cut(_integers(part.column(2).to_pylist(), how, layout), how, layout):
                    order, *nodes = _tree(points)
                    columns[0].append(order.astype(np.int32).tobytes())
                    for column, values in zip(columns[1:], [points[order], *nodes]):
                        column.append(layout.dump(values))
                arrays = [pa.array([part.column(0)], pa.list_(pa.int64())), pa.array([part.column(1)], pa.list_(pa.string()))]
                arrays += [pa.array([column], pa.list_(pa.binary())) for column in columns]
                yield pa.RecordBatch.from_arrays(arrays, names=["ids", "keys", "orders", "points", "low", "high", "total"])

    return kept.mapInArrow(run, BLOCK)


# The walk.


def _entry_tree(entries: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The order of the entries; for each level (edges, least, greatest), the last of single entries."""
    n, order, levels = len(entries), np.arange(len(entries)), []
    for level in range((n - 1).bit_length() + 1):
        edges, here = _edges(n, level), entries[order]
        spans = [here[a:b] if a < b else here[:1] for a, b in zip(edges[:-1], edges[1:])]
        low, high = np.array([s.min(0) for s in spans]), np.array([s.max(0) for s in spans])
        levels.append((edges, low, high))
        if edges[-1] > 1 and entries.shape[1]:
            node = np.repeat(np.arange(1 << level), np.diff(edges))
            widest = np.argmax(high - low, axis=1)
            order = order[np.lexsort((here[np.arange(n), widest[node]], node))]
    return order, levels


def nearest(points: np.ndarray, low: np.ndarray, high: np.ndarray, total: np.ndarray, entries: np.ndarray):
    """The nearest entry of each part (in the tree's order, the lower index of equals), and sums by entry.

    ``sums`` has the summed components of the parts of each entry, ``counts`` their number.
    """
    n, width, kind = len(points), points.shape[1], points.dtype
    found = np.zeros(n, np.int64)
    sums, counts = np.zeros((len(entries), width), kind), np.zeros(len(entries), np.int64)
    if not width:  # nothing to compare: all parts are equal
        counts[0] = n
        return found, sums, counts
    order, levels = _entry_tree(entries)
    depth = _depth(n)
    node, group, level, step = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
    while len(node):
        if step < len(levels) - 1:  # the entries' side one level down
            step += 1
            edges = levels[step][0]
            node, group = np.repeat(node, 2), np.stack([2 * group, 2 * group + 1], 1).ravel()
            there = edges[group] < edges[group + 1]
            node, group = node[there], group[there]
        single = step == len(levels) - 1
        at = node + (1 << level) - 1
        a, b, c, d = low[at], high[at], levels[step][1][group], levels[step][2][group]
        least = _squares(np.maximum(np.maximum(c - b, a - d), 0))
        most = _squares(np.maximum(np.abs(b - c), np.abs(d - a)))
        runs = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        of = np.cumsum(np.r_[True, node[1:] != node[:-1]]) - 1
        bound = np.minimum.reduceat(most, runs)[of]
        keep = least <= bound
        if single:
            # Of the entry with the least bound, all that lie beyond its half of the space go.
            best = np.zeros(len(runs), np.int64)
            tight = np.flatnonzero(most == bound)[::-1]
            best[of[tight]] = tight
            rival = c[best[of]]
            away = c - rival
            reach = np.maximum(a * away, b * away).sum(axis=1)
            nearer = _squares(c) - _squares(rival) - 2 * reach
            keep &= (nearer <= 0) | (best[of] == np.arange(len(node)))
        node, group = node[keep], group[keep]
        if single:
            alone = np.ones(len(node), bool)
            same = node[1:] == node[:-1]
            alone[1:] &= ~same
            alone[:-1] &= ~same
            edges = _edges(n, level)
            for q, e in zip(node[alone], order[levels[step][0][group[alone]]]):
                found[edges[q] : edges[q + 1]] = e
                sums[e] += total[q + (1 << level) - 1]
                counts[e] += edges[q + 1] - edges[q]
            node, group = node[~alone], group[~alone]
        if level < depth:
            level += 1
            # Both halves of a box with all its entries, sorted by box.
            node = np.concatenate([2 * node, 2 * node + 1])
            group = np.concatenate([group, group])
            sort = np.argsort(node, kind="stable")
            node, group = node[sort], group[sort]
        elif single:
            _leaves(points, entries, node, order[levels[step][0][group]], found, sums, counts)
            break
    return found, sums, counts


def _squares(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)


def _leaves(points, entries, node, entry, found, sums, counts) -> None:
    """Uncertain leaves: each part against each entry left for its leaf."""
    if not len(node):
        return
    edges = _edges(len(points), _depth(len(points)))
    leaves, first = np.unique(node, return_index=True)
    for leaf, own in zip(leaves, np.split(entry, first[1:])):
        own = np.sort(own)
        here = points[edges[leaf] : edges[leaf + 1]]
        gap = here[:, None, :] - entries[own][None, :, :]
        found[edges[leaf] : edges[leaf + 1]] = own[np.argmin((gap * gap).sum(axis=2), axis=1)]
    rows = np.concatenate([np.arange(edges[leaf], edges[leaf + 1]) for leaf in leaves])
    np.add.at(sums, found[rows], points[rows])
    np.add.at(counts, found[rows], 1)


def _walked(batch: pa.RecordBatch, books: list[np.ndarray], layout: Layout):
    """(block, part, its points in tree order, what ``nearest`` says) for all blocks of a batch."""
    names = batch.schema.names
    for i in range(batch.num_rows):
        row = {name: batch.column(names.index(name))[i] for name in ("points", "low", "high", "total")}
        for p, book in enumerate(books):
            points, *nodes = (layout.load(row[name][p].as_py()) for name in row)
            if not layout.width:
                points = np.zeros((len(batch.column(0)[i]), 0), layout.kind)
            yield i, p, points, nearest(points, *nodes, book)


def _sums(blocks: DataFrame, books: list[np.ndarray], layout: Layout) -> dict:
    """For each (part, entry): the number of its parts and their summed components."""
    width, digits = layout.width + 1, layout.digits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for _, p, _, (_, sums, counts) in _walked(batch, books, layout):
                for e in np.flatnonzero(counts):
                    row = np.array([int(counts[e]), *map(int, sums[e])], object)
                    held[p, int(e)] = held.get((p, int(e)), 0) + row
        keys = sorted(held)
        flat = [[x >> DIGIT_BITS * k & 0xFFFFFFFF if k < digits - 1 else x >> DIGIT_BITS * k for x in held[key] for k in range(digits)] for key in keys]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
                pa.array(flat, pa.list_(pa.int64())),
            ],
            names=["part", "entry", "total"],
        )

    tasks = blocks.select("ids", "points", "low", "high", "total").mapInArrow(run, "part int, entry int, total array<long>")
    places = tasks.select("part", "entry", F.posexplode("total").alias("place", "total"))
    out: dict = {}
    for r in places.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect():
        whole = out.setdefault((r.part, r.entry), [0] * width)
        whole[r.place // digits] += r.total << DIGIT_BITS * (r.place % digits)
    return out


def _moved(books: list[np.ndarray], sums: dict) -> list[np.ndarray]:
    """Each entry at the floored mean of its parts; unused ones stay."""
    out = [book.copy() for book in books]
    for (p, e), (count, *total) in sums.items():
        out[p][e] = [x // count for x in total]
    return out


def _coded(blocks: DataFrame, books: list[np.ndarray], layout: Layout) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes: dict[int, np.ndarray] = {}
            errors: dict[int, np.ndarray] = {}
            for i, p, points, (found, _, _) in _walked(batch, books, layout):
                n = len(found)
                order = np.frombuffer(batch.column(2)[i][p].as_py(), np.int32)
                code = codes.setdefault(i, np.zeros((n, len(books)), np.uint8))
                error = errors.setdefault(i, np.zeros(n, layout.kind))
                code[order, p] = found
                error[order] += _squares(points - books[p][found])
            for i, code in codes.items():
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[i].values, batch.column(1)[i].values, pa.array([c.tobytes().hex() for c in code], pa.string()),
                        pa.array([min(int(x), MOST) for x in errors[i]], pa.int64()),
                    ],
                    names=["id", "key", "code", "error"],
                )

    return blocks.select("ids", "keys", "orders", "points", "low", "high", "total").mapInArrow(
        run, "id long, key string, code string, error long"
    )
