"""Ranked search over texts: short lists summed first, long lists walked with skips.

Documents are indexed in shards of some megabytes, each a row with its inverted lists. A query
meets a shard in two steps. The lists of its rare terms are short: they are summed term at a
time into accumulators, one score per document. These accumulators then are one more list,
bounded by their greatest sum, among the long lists of the frequent terms, and all are walked
document at a time, one window of documents after the other: a window whose bounds cannot reach
the score of the worst row kept so far is skipped unread, and inside a window lists that cannot
lift a document alone are only looked into for the documents that others name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logharrow.llm.common import id_and_text
from logharrow.session import settled

# Bytes of text and documents in a shard; a longer text has a shard of its own.
SHARD_BYTES = 8 << 20
SHARD_ROWS = 1 << 15
# Texts are taken apart in pieces of this size.
PIECE_BYTES = 1 << 20
# Lists of at most this many documents of a shard are summed into accumulators.
SHORT_LIST = 96
# Postings a skip entry stands for, and documents in a window of the walk.
SKIP = 64
WINDOW = 1_024
# Text of the queries answered in one pass over the index.
QUERY_BYTES = 4 << 20
# Groups in which the rows of one query are cut to its best before they meet.
SALTS = 64

# Letters and digits of ASCII and all bytes of other characters make up terms; A-Z are lower-cased.
_FOLD = bytearray(b" " * 128 + bytes(range(128, 256)))
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _FOLD[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _FOLD[_c] = _c + 32
FOLD = bytes(_FOLD)


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in order, piece by piece, as UTF-8."""
    data = text.encode()
    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE_BYTES)
        piece = data[at:end].translate(FOLD)
        cut = piece.rfind(b" ") + 1 if end < len(data) else len(piece)
        while not cut:  # one term longer than a piece
            end = min(len(data), end + PIECE_BYTES)
            piece = data[at:end].translate(FOLD)
            cut = piece.rfind(b" ") + 1 if end < len(data) else len(piece)
        yield piece[:cut].split()
        at += cut


@dataclass(frozen=True)
class Ranking:
    """How documents are scored: whole numbers of ``unit``, divisions round down.

    A term counts w = floor(weight_unit * ln((2N + 2) / (2 df + 1))) in each of ``top`` rows' scores,
    times unit * tf / (tf_unit * tf + slope * m), m being ``100 - b`` and b times the document's length
    over the mean length.
    """

    top: int = 20
    b: int = 25
    slope: int = 12
    tf_unit: int = 1_000
    unit: int = 1_000_000_000
    weight_unit: int = 1_000

    def weight(self, df: int, n_docs: int) -> int:
        return math.floor(self.weight_unit * math.log((2 * n_docs + 2) / (2 * df + 1)))

    def stretch(self, lengths: np.ndarray, n_docs: int, total: int) -> np.ndarray:
        return 100 - self.b + self.b * lengths * n_docs // max(total, 1)

    def share(self, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        return self.unit * tf // (self.tf_unit * tf + self.slope * m)


INDEX = "ids array<long>, lengths binary, terms binary, counts binary, docs binary, tfs binary, most binary, shortest binary"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents as shards of inverted lists, written once to the shared folder.

    One row per shard: ids and lengths of its documents, its terms, and for each term the
    documents that hold it, ascending, with their counts; for every SKIP postings of a list the
    greatest count and the least length are noted. Documents without terms, NULL texts among
    them, are there with length 0. Documents stay in the partitions of the scan.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdCompressor(3)
        ids: list = []
        lengths: list[int] = []
        known: dict[bytes, int] = {}
        parts: list[np.ndarray] = []
        held = 0

        def shard() -> pa.RecordBatch:
            sizes = np.array(lengths, np.int64)
            flat = np.concatenate([*parts, np.zeros(0, np.int64)])
            keys, tfs = np.unique(flat * len(ids) + np.repeat(np.arange(len(ids)), sizes), return_counts=True)
            term, doc = np.divmod(keys, len(ids))
            counts = np.bincount(term, minlength=len(known))
            gaps = np.diff(doc, prepend=0)
            heads = _heads(counts)
            most = np.maximum.reduceat(tfs, heads) if len(heads) else tfs
            shortest = np.minimum.reduceat(sizes[doc], heads) if len(heads) else tfs
            packed = [
                sizes, b" ".join(known), counts.astype(np.int32), gaps.astype(np.int32), tfs.astype(np.int32),
                most.astype(np.int32), shortest.astype(np.int64),
            ]
            packed = [zstd.compress(x if isinstance(x, bytes) else x.tobytes()) for x in packed]
            names = ["ids", "lengths", "terms", "counts", "docs", "tfs", "most", "shortest"]
            return pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(pa.int64())), *[pa.array([x], pa.binary()) for x in packed]], names=names
            )

        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                if ids and (held + len(text) > SHARD_BYTES or len(ids) >= SHARD_ROWS):
                    yield shard()
                    ids, lengths, known, parts, held = [], [], {}, [], 0
                n = 0
                for piece in terms_of(text):
                    part = np.array([known.setdefault(t, len(known)) for t in piece], np.int64)
                    parts.append(part)
                    n += len(part)
                ids.append(keys[i].as_py())
                lengths.append(n)
                held += len(text)
        if ids:
            yield shard()

    return settled(id_and_text(docs, id_col, text_col).mapInArrow(run, INDEX), "search-index")


def _heads(counts: np.ndarray) -> np.ndarray:
    """Where the stretches of SKIP postings start, over all lists one behind the other."""
    skips = -(-counts // SKIP)
    starts = np.repeat(np.cumsum(counts) - counts, skips)
    within = np.arange(skips.sum()) - np.repeat(np.cumsum(skips) - skips, skips)
    return starts + within * SKIP


def _array(data: pa.Scalar, kind) -> np.ndarray:
    return np.frombuffer(_bytes(data), kind)


def _bytes(data: pa.Scalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data.as_py())


@dataclass
class Query:
    """One item: its number among all, its id, and how often it holds each term."""

    number: int
    item: int | None
    terms: dict[bytes, int]


def search(
    docs: DataFrame, items: DataFrame, how: Ranking = Ranking(), id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The ``how.top`` best documents of each row of ``items``, all documents considered.

    Returns ``item_col``, rank (from 1), ``id_col`` and score: rows of score above 0, equal scores by
    ascending id, NULL ids last. Items without terms, NULL texts among them, have no rows; repeated
    items are items of their own and are ranked each. Items are answered in passes of QUERY_BYTES of
    text, so any number of them can be asked; what is sent to the tasks is bounded by that.
    """
    index = build_index(docs, id_col, text_col)
    size = F.octet_length(F.coalesce(F.col(item_text_col), F.lit("")))
    asked = items.select(F.col(item_col).cast("long").alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"), size.alias("size"))
    asked = settled(asked.withColumn("number", F.monotonically_increasing_id()), "items")
    passes = (asked.agg(F.sum("size")).first()[0] or 0) // QUERY_BYTES + 1
    totals = index_totals(index)
    found = []
    for k in range(passes):
        rows = asked.where(F.pmod(F.xxhash64("number"), F.lit(passes)) == k).select("number", "item", "text")
        queries = [Query(r.number, r.item, dict(Counter(t for piece in terms_of(r.text) for t in piece))) for r in rows.collect()]
        found.append(settled(answers(index, [q for q in queries if q.terms], totals, how), "found"))
    best = found[0]
    for more in found[1:]:
        best = best.union(more)
    return best.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def index_totals(index: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            for data in batch.column(0):
                lengths = _array(data, np.int64)
                n, total = n + int((lengths > 0).sum()), total + int(lengths.sum())
        yield pa.RecordBatch.from_pydict({"n": [n], "total": [total]})

    row = index.select("lengths").mapInArrow(run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0


def document_counts(index: DataFrame, terms: set[bytes]) -> dict[bytes, int]:
    """In how many documents each of the given terms is; those in none are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for names, counts in zip(batch.column(0), batch.column(1)):
                counts = _array(counts, np.int32)
                for i, term in enumerate(_bytes(names).split()):
                    if term in terms:
                        total[term] += int(counts[i])
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["term", "n"]
        )

    tasks = index.select("terms", "counts").mapInArrow(run, "term binary, n long")
    return {bytes(r.term): r.n for r in tasks.groupBy("term").agg(F.sum("n").alias("n")).collect()}


def answers(index: DataFrame, queries: list[Query], totals: tuple[int, int], how: Ranking) -> DataFrame:
    """The best rows of some queries, (number, item, rank, id, score)."""
    n_docs, length = totals
    df = document_counts(index, {t for q in queries for t in q.terms})
    weights = {t: how.weight(n, n_docs) for t, n in df.items()}
    weighted = [(q, {t: k * weights[t] for t, k in q.terms.items() if weights.get(t, 0) > 0}) for q in queries]
    weighted = [(q, w) for q, w in weighted if w]
    wanted = {t for _, w in weighted for t in w}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(how.top) for _ in weighted]
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard({name: batch.column(j)[i] for j, name in enumerate(batch.schema.names)}, wanted, how, totals)
                for (_, own), top in zip(weighted, best):
                    shard.walk(own, top)
        rows = [(q.number, q.item, *row) for (q, _), top in zip(weighted, best) for row in top.rows()]
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["number", "item", "id", "score"])

    rows = index.mapInArrow(run, "number long, item long, id long, score long")
    order = [F.desc("score"), F.col("id").asc_nulls_last()]
    rank = F.row_number().over(Window.partitionBy("number", F.pmod(F.spark_partition_id(), F.lit(SALTS))).orderBy(*order))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= how.top)
    rank = F.row_number().over(Window.partitionBy("number").orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= how.top).select("number", "item", "rank", "id", "score")


class Best:
    """The best rows of a query that a task has seen."""

    def __init__(self, top: int):
        self.top, self.score, self.ids, self.null = top, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """A row must reach this to be among the best; an equal one may, by its id."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids, null = (np.concatenate(x) for x in ((self.score, score), (self.ids, ids), (self.null, null)))
        order = np.lexsort((ids, null, -score))[: self.top]
        self.score, self.ids, self.null = score[order], ids[order], null[order]

    def rows(self) -> Iterator[tuple]:
        for score, key, null in zip(self.score, self.ids, self.null):
            yield None if null else int(key), int(score)


class Shard:
    """The lists of a shard that some query asks for."""

    def __init__(self, row: dict, wanted: set[bytes], how: Ranking, totals: tuple[int, int]):
        ids = row["ids"].values
        self.null = np.asarray(ids.is_null())
        self.ids = np.asarray(ids.fill_null(0))
        self.m = how.stretch(_array(row["lengths"], np.int64), *totals)
        counts = _array(row["counts"], np.int32).astype(np.int64)
        ends = np.cumsum(counts)
        skips = -(-counts // SKIP)
        skip_ends = np.cumsum(skips)
        docs = np.cumsum(_array(row["docs"], np.int32).astype(np.int64))
        tfs, most = _array(row["tfs"], np.int32), _array(row["most"], np.int32)
        least = how.stretch(_array(row["shortest"], np.int64), *totals)
        self.how, self.lists = how, {}
        for i, term in enumerate(_bytes(row["terms"]).split()):
            if term in wanted:
                own, over = slice(ends[i] - counts[i], ends[i]), slice(skip_ends[i] - skips[i], skip_ends[i])
                self.lists[term] = List(docs[own], tfs[own], most[over], least[over], how)

    def _share(self, docs: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        return self.how.share(tfs.astype(np.int64), self.m[docs])

    def walk(self, weights: dict[bytes, int], best: Best) -> None:
        """Adds this shard's best documents for one query."""
        own = [(self.lists[t], w) for t, w in weights.items() if t in self.lists]
        if not own:
            return
        short = [(x, w) for x, w in own if len(x.docs) <= SHORT_LIST]
        long = [(x, w) for x, w in own if len(x.docs) > SHORT_LIST]
        docs, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if short:  # term at a time
            every = np.concatenate([x.docs for x, _ in short])
            part = np.concatenate([self._share(x.docs, x.tfs) * w for x, w in short])
            docs, at = np.unique(every, return_inverse=True)
            np.add.at(sums := np.zeros(len(docs), np.int64), at, part)
        if sum(x.bound * w for x, w in long) + (int(sums.max()) if len(sums) else 0) < best.least:
            return
        if not long:
            self._offer(docs, sums, best)
            return
        # Windows that hold a document, and the bound of each list in each.
        n = -(-len(self.ids) // WINDOW)
        bounds = np.array([x.window_bounds(n) * w for x, w in long])
        summed = np.zeros(n, np.int64)
        np.maximum.at(summed, docs // WINDOW, sums)
        total = bounds.sum(axis=0) + summed
        for k in range(n):
            if total[k] < best.least:
                continue
            first, last = np.searchsorted(docs, [k * WINDOW, (k + 1) * WINDOW])
            self._window(k, long, bounds[:, k], docs[first:last], sums[first:last], int(summed[k]), best)

    def _window(self, k: int, long: list, bounds: np.ndarray, docs: np.ndarray, sums: np.ndarray, summed: int, best: Best) -> None:
        """Document at a time within a window, on a dense row of scores; -1 marks documents nobody named."""
        start = k * WINDOW
        # Lists by bound; the first ones, and the accumulators, that together stay below the least name nobody.
        order = np.argsort(bounds, kind="stable")
        below = np.cumsum(bounds[order])
        quiet = int(np.searchsorted(below, best.least, "left"))
        score = np.full(WINDOW, -1, np.int64)
        if not (quiet == len(order) and below[-1] + summed < best.least):
            score[docs - start] = sums
        for i in order[quiet:]:
            x, w = long[i]
            own = x.window(k)
            at = x.docs[own] - start
            score[at] = np.maximum(score[at], 0) + self._share(x.docs[own], x.tfs[own]) * w
        rest = int(below[quiet - 1]) if quiet else 0
        named = np.flatnonzero(score >= max(0, best.least - rest))
        for i in order[:quiet][::-1]:  # looked into from the highest bound down
            if not len(named):
                return
            x, w = long[i]
            own = x.window(k)
            list_docs = x.docs[own]
            at = np.searchsorted(list_docs, named + start)
            hit = at < len(list_docs)
            hit[hit] = list_docs[at[hit]] == named[hit] + start
            score[named[hit]] += self._share(list_docs[at[hit]], x.tfs[own][at[hit]]) * w
            rest -= int(bounds[i])
            named = named[score[named] + rest >= best.least]
        self._offer(named + start, score[named], best)

    def _offer(self, docs: np.ndarray, score: np.ndarray, best: Best) -> None:
        good = score >= best.least
        if good.any():
            docs = docs[good]
            best.add(score[good], self.ids[docs], self.null[docs])


class List:
    """One term's documents in a shard, and the bounds of its stretches."""

    def __init__(self, docs: np.ndarray, tfs: np.ndarray, most: np.ndarray, least: np.ndarray, how: Ranking):
        self.docs, self.tfs = docs, tfs
        # The share grows with the count and falls with the length.
        self.shares = how.share(most.astype(np.int64), least)
        self.bound = int(self.shares.max())
        self._edges: np.ndarray | None = None
        self._bounds: np.ndarray | None = None

    def window_bounds(self, n: int) -> np.ndarray:
        """The greatest share any of the list's documents can have in each window; 0 where there is none."""
        if self._bounds is None:
            self._edges = np.searchsorted(self.docs, np.arange(n + 1) * WINDOW)
            self._bounds = np.zeros(n, np.int64)
            for k in np.flatnonzero(self._edges[1:] > self._edges[:-1]):
                self._bounds[k] = self.shares[self._edges[k] // SKIP : (self._edges[k + 1] - 1) // SKIP + 1].max()
        return self._bounds

    def window(self, k: int) -> slice:
        return slice(self._edges[k], self._edges[k + 1])
