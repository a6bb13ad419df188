"""Exact n-gram Jaccard join, size-aware: subsets for small sets, inverted lists for large.

Shingles are put in one global order, rarest first by counts over all documents. A set
of n shingles that is to share at least c of them with another shares at least k within
its first n - c + k. Small (light) sets therefore emit every subset of fixed size two of
their first n - c + 2 shingles, and two light sets meet in an equal subset. Large (heavy) sets,
and the light ones big enough to match one, are posted in inverted lists under their
first n - c + 1 shingles. The boundary is the size for which both ways together cost least.

Sets that share a list or subset are candidates if sizes and places in the order leave room
for the similarity. Lists are not multiplied out: each set is first compared with one leading
set of its lists; lists whose sets that has not joined into one group go on with
four times as many leading sets, until all are settled. Only pairs that are not yet connected
are compared, so groups of copies cost about one comparison a row, yet no link that
connects different groups is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logharrow.llm.blocks import PLACE_BITS, block_table, rids, unpack
from logharrow.llm.components import components
from logharrow.llm.hashing import _STEP, mix, shingle_sets
from logharrow.operators.lookup import lookup_join
from logharrow.session import settled

U = np.uint64
# Slots in which shingles are counted; a fixed size, 2 MB when broadcast as levels.
SLOT_BITS = 21
SLICE = 1 << 16
# Largest set size for which subsets are considered.
MAX_LIGHT = 400
# Comparisons with one set that a task makes; a set with more partners goes to several tasks.
PARTNERS = 4_096


@dataclass(frozen=True)
class Jaccard:
    """A similarity of at least ``up / down`` between sets of ``n``-word shingles."""

    n: int = 5
    up: int = 80
    down: int = 100

    def __post_init__(self):
        if not self.down < 2 * self.up <= 2 * self.down:
            raise ValueError("the similarity must be over one half and at most one")

    def least(self, size):
        """Shingles a set of this size shares with any set similar to it."""
        return (size * self.up + self.down - 1) // self.down

    def prefix(self, size, k: int):
        return np.minimum(size, size - self.least(size) + k)


def ngram_components(
    docs: DataFrame, rule: Jaccard = Jaccard(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The group of every document under links of similar shingle sets.

    Returns ``id_col``, n_shingles and component_id, the smallest id reachable by links,
    the document itself included; one row per row of ``docs``. Documents without words, NULL
    texts among them, are linked with nothing. Repeated rows and equal sets are linked. A
    NULL id is an id like others for links but never the smallest unless alone. Columns other
    than the two named are not read.
    """
    rows, lone = _labelled(block_table(docs, id_col, text_col), rule)
    smallest = rows.groupBy("label").agg(F.min("id").alias("component_id"))
    found = _looked_up(rows, smallest).select("id", "n", "component_id")
    lone = lone.select("id", "n", F.col("id").alias("component_id"))
    return found.union(lone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _labelled(blocks: DataFrame, rule: Jaccard) -> tuple[DataFrame, DataFrame]:
    """Rows with words and their group's ``label`` as text, and rows without; both (id, rid, mark, n)."""
    stats = settled(_stats(blocks, rule), "sets")
    worded = stats.where("n > 0")
    classes = worded.groupBy("d1", "d2").agg(F.min("rid").alias("rid"), F.first("n").alias("n"))
    classes = settled(classes, "classes")
    links = linked_classes(blocks, classes, rule)
    labelled = classes.join(links.withColumnRenamed("node", "rid"), "rid", "left").select(
        "d1", "d2", F.coalesce("label", "rid").cast("string").alias("label")
    )
    # Equal sets of very many documents are one hot key: looked up, not gathered.
    key = F.concat_ws("/", "d1", "d2").alias("key")
    rows = lookup_join(worded.select("id", "rid", "mark", "n", key), labelled.select(key, "label"), "key").drop("key")
    return settled(rows, "labelled"), stats.where("n = 0").select("id", "rid", "mark", "n")


def _looked_up(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with what a table says of their label, hot labels spread over all tasks."""
    return lookup_join(rows, settled(table, "by-label"), "label")


def group_leaders(
    docs: DataFrame, rule: Jaccard = Jaccard(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of each group of linked documents, with all its columns: that of the smallest id.

    NULL ids come last; of rows that share the smallest id, that of the least digest of its text leads,
    and of rows that share both one stays. Rows without words are linked with nothing and all stay. Only
    rows that go, and leading ones that are repeated, are looked up by the documents.
    """
    rows, _ = _labelled(block_table(docs, id_col, text_col), rule)
    place = F.struct(F.col("id").isNull(), "id", "mark")
    leads = rows.groupBy("label").agg(F.min(place).alias("first"))
    by_row = _looked_up(rows, leads).select(_mark_key(F.col("id"), F.col("mark")).alias("_key"), (place == F.col("first")).alias("leads"))
    # Rows of one key have one text, so they are of one group and lead, or go, together.
    verdicts = by_row.groupBy("_key").agg(F.bool_or("leads").alias("_leads"), F.count("*").alias("_n"))
    verdicts = settled(verdicts.where("not _leads OR _n > 1").select("_key", "_leads"), "gone")
    key = _mark_key(F.col(id_col).cast("long"), F.md5(F.coalesce(text_col, F.lit(""))))
    own = docs.select(F.struct(*docs.columns).alias("_row"), key.alias("_key"))
    judged = lookup_join(own, verdicts, "_key")
    once = judged.where("_leads").groupBy("_key").agg(F.first("_row").alias("_row"))
    return judged.where("_leads IS NULL").select("_row").unionByName(once.select("_row")).select("_row.*")


def _mark_key(key: Column, mark: Column) -> Column:
    return F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), mark)


def _stats(blocks: DataFrame, rule: Jaccard) -> DataFrame:
    """Per document: its row number, a mark of its text, set size and a 128-bit digest of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, sizes, payload in zip(*(batch.column(i) for i in range(4))):
                data, ends = unpack(payload.as_py()), np.cumsum(sizes.as_py())
                marks = [hashlib.md5(data[e - s : e], usedforsecurity=False).hexdigest() for e, s in zip(ends, sizes.as_py())]
                sets = shingle_sets(data, sizes.as_py(), rule.n)
                first = [int(s.sum(dtype=np.uint64)) for s in sets]
                second = [int(mix(s ^ _STEP[70]).sum(dtype=np.uint64)) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.values,
                        pa.array(rids(block.as_py(), len(sets))),
                        pa.array(marks, pa.string()),
                        pa.array(np.array([len(s) for s in sets], np.int64)),
                        pa.array(np.array(first, np.uint64).view(np.int64)),
                        pa.array(np.array(second, np.uint64).view(np.int64)),
                    ],
                    names=["id", "rid", "mark", "n", "d1", "d2"],
                )

    return blocks.mapInArrow(run, "id long, rid long, mark string, n long, d1 long, d2 long")


def _with_rows(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """Blocks with the row numbers among ``rows`` (rid) that lie in them; texts stay in place."""
    wanted = rows.groupBy(F.shiftright("rid", PLACE_BITS).alias("block")).agg(F.collect_list("rid").alias("rids"))
    return blocks.join(wanted, "block").select("block", "sizes", "payload", "rids")


def _chosen_sets(batch: pa.RecordBatch, i: int, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The row numbers asked for in block ``i`` of the batch, and their sets."""
    block, sizes, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), unpack(batch.column(2)[i].as_py())
    wanted = np.unique(np.array(batch.column(3)[i].as_py(), np.int64))
    places = wanted - rids(block, 1)[0]
    ends = np.cumsum(sizes)
    texts = [data[ends[p] - sizes[p] : ends[p]] for p in places]
    return wanted, shingle_sets(b"".join(texts), [len(t) for t in texts], n)


def linked_classes(blocks: DataFrame, classes: DataFrame, rule: Jaccard) -> DataFrame:
    """Components, (node, label), of the classes (rid, n) that have a link to another."""
    spark = blocks.sparkSession
    chosen = _with_rows(blocks, classes)
    levels, list_length = _levels(chosen, rule)
    boundary = light_boundary(classes, rule, list_length)
    postings = _postings(chosen, spark.sparkContext.broadcast(levels), rule, boundary)
    return _link(blocks, settled(_shared(settled(postings, "postings")), "lists"), rule)


def _levels(chosen: DataFrame, rule: Jaccard) -> tuple[np.ndarray, float]:
    """How common shingles are, by slot, and how many sets a prefix shingle is met in.

    Each task counts its sets' shingles in a fixed number of slots, by hash; the counts are
    added up by slices of slots. Any order of shingles gives the same links, so slots shared
    by chance cost speed only. The driver gets a byte a slot, and sums by level, not counts.
    """
    slots = 1 << SLOT_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.uint32)
        for batch in batches:
            for i in range(batch.num_rows):
                sets = _chosen_sets(batch, i, rule.n)[1]
                for at in range(0, len(sets), 256):
                    slot = np.concatenate(sets[at : at + 256]) >> U(64 - SLOT_BITS)
                    where, n = np.unique(slot, return_counts=True)
                    total[where] += n.astype(np.uint32)
        zstd = zstandard.ZstdCompressor(3)
        parts = [zstd.compress(total[at : at + SLICE].tobytes()) for at in range(0, slots, SLICE)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int64()), pa.array(parts)], names=["slice", "counts"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLICE, np.uint64)
        for batch in batches:
            for counts in batch.column(1):
                total += np.frombuffer(unpack(counts.as_py()), np.uint32)
        level = np.round(8 * np.log2(1 + total)).clip(0, 255).astype(np.uint8)
        sums = np.stack([np.bincount(level, total.astype(float) ** k, 256) for k in range(3)])
        columns = [pa.array([key[0].as_py()]), *(pa.array([x.tobytes()]) for x in (level, sums))]
        yield pa.RecordBatch.from_arrays(columns, names=["slice", "levels", "sums"])

    counted = chosen.mapInArrow(count, "slice long, counts binary").groupBy("slice")
    levels, sums = np.zeros(slots, np.uint8), np.zeros((3, 256))  # without documents there are no slices
    for row in counted.applyInArrow(add, "slice long, levels binary, sums binary").collect():
        levels[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.frombuffer(row["levels"], np.uint8)
        sums += np.frombuffer(row["sums"]).reshape(3, 256)
    return levels, _list_length(sums, (rule.down - rule.up) / rule.down)


def _list_length(sums: np.ndarray, part: float) -> float:
    """Sets that a prefix shingle is met in, from slots, counts and squared counts of each level.

    Prefixes hold the rarest part of the shingles; of the level in which it ends a share
    counts. What meets by chance is taken off.
    """
    slots, counts, squares = sums
    before = np.cumsum(counts) - counts
    share = ((part * counts.sum() - before) / np.maximum(counts, 1.0)).clip(0, 1)
    return max(1.0, (share @ squares) / max(share @ counts, 1.0) - counts.sum() / max(slots.sum(), 1.0))


def light_boundary(classes: DataFrame, rule: Jaccard, list_length: float) -> int:
    """The largest light size for which subsets emitted and list entries scanned cost least."""
    sizes = dict(
        classes.groupBy(F.least("n", F.lit(MAX_LIGHT + 1)).alias("n")).count().collect()  # MAX_LIGHT + 1 at most
    )
    size = np.arange(MAX_LIGHT + 1)
    many = np.array([sizes.get(int(s), 0) for s in size], float)
    two, one = rule.prefix(size, 2), rule.prefix(size, 1)
    subsets = many * two * (two - 1) / 2
    scanned = many * one * (1 + list_length)
    costs = []
    for b in size:
        posted = size >= rule.least(b)  # heavy sets, and light ones that may match them
        costs.append(subsets[: b + 1].sum() + scanned[posted].sum())
    return int(np.argmin(costs))


def _postings(chosen: DataFrame, levels, rule: Jaccard, boundary: int) -> DataFrame:
    """Entries (sig, rid, n, pos): subsets of light sets, prefix shingles of heavy and border ones.

    ``pos`` says how many of the set's shingles are known not to be shared, if the list's
    shingles are the first that two sets share: those before them in the order.
    """
    border = rule.least(boundary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for batch in batches:
            for i in range(batch.num_rows):
                sigs, owners, sizes, skipped = [], [], [], []
                for rid, tokens in zip(*_chosen_sets(batch, i, rule.n)):
                    n = len(tokens)
                    ranked = tokens[np.lexsort((tokens, level[tokens >> U(64 - SLOT_BITS)]))]
                    made, pos = [], []
                    if n >= border:
                        made.append(mix(ranked[: rule.prefix(n, 1)] + _STEP[71]))
                        pos.append(np.arange(len(made[-1])))
                    if n <= boundary:
                        first = ranked[: rule.prefix(n, 2)]
                        a, b = np.triu_indices(len(first), 1)
                        # A subset has no order: the smaller hash comes first.
                        low, high = np.minimum(first[a], first[b]), np.maximum(first[a], first[b])
                        made.append(mix(low * _STEP[72] + high))
                        pos.append(b - 1)
                    sig = np.concatenate(made)
                    sigs.append(sig)
                    owners.append(np.full(len(sig), rid))
                    sizes.append(np.full(len(sig), n))
                    skipped.append(np.concatenate(pos))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(sigs).view(np.int64)),
                        pa.array(np.concatenate(owners)),
                        pa.array(np.concatenate(sizes).astype(np.int32)),
                        pa.array(np.concatenate(skipped).astype(np.int32)),
                    ],
                    names=["sig", "rid", "n", "pos"],
                )

    return chosen.mapInArrow(run, "sig long, rid long, n int, pos int")


def _shared(postings: DataFrame) -> DataFrame:
    """Entries of lists with at least two sets, each with the leading set of its list.

    The set that skips fewest shingles leads: what it was copied to skips more.
    """
    lists = postings.groupBy("sig").agg(
        F.min(F.struct("pos", "rid", "n")).alias("first"), F.min("rid").alias("low"), F.max("rid").alias("high")
    )
    return postings.join(lists.where("low < high").select("sig", "first"), "sig")


def _fits(rule: Jaccard, n, pos, m, other):
    """Whether sizes and skipped shingles of two sets leave room for the similarity."""
    shared = F.least(n - pos, m - other).cast("long")
    return shared * rule.down >= (n + m - shared) * rule.up


def _unsettled(entries: DataFrame, labels: DataFrame, rule: Jaccard) -> DataFrame:
    """Entries that may still be similar to one of another label in their list.

    The best any entry could do is to meet the set of another label that skips fewest.
    """
    named = entries.select("sig", "rid", "n", "pos").join(labels.withColumnRenamed("node", "rid"), "rid", "left")
    named = settled(named.withColumn("label", F.coalesce("label", "rid")), "named")
    best = named.groupBy("sig").agg(F.min(F.struct("pos", "label")).alias("best"), F.min("label").alias("x"), F.max("label").alias("y"))
    mixed = named.join(best.where("x <> y").select("sig", "best"), "sig")
    second = mixed.where("label <> best.label").groupBy("sig").agg(F.min("pos").alias("second"))
    other = F.when(F.col("label") == F.col("best.label"), F.col("second")).otherwise(F.col("best.pos"))
    n, pos = F.col("n").cast("long"), F.col("pos")
    left = mixed.join(second, "sig").where((n - pos) * rule.down >= (n + other) * rule.up)
    return settled(left.select("sig", "rid", "n", "pos", "label"), "unsettled")


def _ranked(entries: DataFrame, labels: DataFrame, rule: Jaccard) -> DataFrame:
    """The unsettled entries with their rank in their list, and how many that has."""
    order = Window.partitionBy("sig").orderBy("pos", "rid")
    ranked = _unsettled(entries, labels, rule).withColumn("rank", F.row_number().over(order))
    return settled(ranked.withColumn("many", F.count("*").over(Window.partitionBy("sig"))), "ranked")


def _link(blocks: DataFrame, entries: DataFrame, rule: Jaccard) -> DataFrame:
    # First every set meets one other: of the sets leading its lists, that which skips fewest.
    first = F.col("first")
    started = entries.where(F.col("rid") != first["rid"]).where(
        _fits(rule, F.col("n"), F.col("pos"), first["n"], first["pos"])
    )
    pairs = started.groupBy("rid").agg(F.min(F.struct(first["pos"], first["rid"].alias("rid"))).alias("to"))
    tested = _verified(pairs.select(F.col("to.rid").alias("a"), F.col("rid").alias("b")), blocks, rule)
    labels = components(tested.where("linked"))
    ranked, led, leading = _ranked(entries, labels, rule), 0, 4
    while True:
        front = ranked.where((F.col("rank") > led) & (F.col("rank") <= leading)).select(
            "sig", F.col("rid").alias("a"), F.col("n").alias("m"), F.col("pos").alias("other"),
            F.col("label").alias("with"), F.col("rank").alias("r"),
        )
        fits = _fits(rule, F.col("n"), F.col("pos"), F.col("m"), F.col("other"))
        pairs = (
            ranked.join(front, "sig")
            .where((F.col("r") < F.col("rank")) & (F.col("label") != F.col("with")) & fits)
            .select(F.least("a", "rid").alias("low"), F.greatest("a", "rid").alias("high"))
            .distinct()
            .join(tested.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")), ["low", "high"], "left_anti")
        )
        fresh = _verified(pairs.select(F.col("low").alias("a"), F.col("high").alias("b")), blocks, rule)
        tested = tested.unionByName(fresh)
        linked = not fresh.where("linked").isEmpty()
        if linked:
            labels = components(tested.where("linked"))
        # Lists no longer than what led are compared in full.
        ranked = ranked.where(F.col("many") > leading)
        if ranked.isEmpty():
            return labels
        # Without new links, ranks stay and the sets that led have met all of their lists.
        ranked, led = (_ranked(ranked, labels, rule), 0) if linked else (ranked, leading)
        leading *= 4


def _verified(pairs: DataFrame, blocks: DataFrame, rule: Jaccard) -> DataFrame:
    """Pairs (a, b) with the exact answer whether their sets are similar enough.

    Compressed texts travel, not sets, and only to their partners: each b to its a, and a
    to every group of at most about PARTNERS of its b. There a's set is made once, and
    the others pass by one at a time.
    """
    pairs = settled(pairs, "pairs")
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("groups"))
    members = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), "groups").alias("salt"), F.col("b").alias("rid"))
    leaders = many.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("salt"), F.col("a").alias("rid"))
    wanted = members.union(leaders).groupBy(F.shiftright("rid", PLACE_BITS).alias("block"))
    asked = blocks.join(wanted.agg(F.collect_list(F.struct("rid", "a", "salt")).alias("asked")), "block")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdCompressor(3)
        for batch in batches:
            for i in range(batch.num_rows):
                block, sizes, payload, rows = (batch.column(k)[i].as_py() for k in range(4))
                data, ends, first = unpack(payload), np.cumsum(sizes), rids(block, 1)[0]
                text = {r: zstd.compress(data[ends[r - first] - sizes[r - first] : ends[r - first]]) for r in {x["rid"] for x in rows}}
                columns = [[x[k] for x in rows] for k in ("a", "salt", "rid")]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in columns), pa.array([text[r] for r in columns[2]], pa.binary())],
                    names=["a", "salt", "rid", "text"],
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, None
        for batch in batches:
            found: list[tuple[int, int, bool]] = []
            for a, rid, text in zip(*(batch.column(k) for k in (0, 2, 3))):
                a, rid, data = a.as_py(), rid.as_py(), unpack(text.as_py())
                tokens = shingle_sets(data, [len(data)], rule.n)[0]
                if a == rid:
                    leader, own = a, tokens
                    continue
                assert leader == a
                shared = len(np.intersect1d(own, tokens, assume_unique=True))
                found.append((a, rid, shared * rule.down >= (len(own) + len(tokens) - shared) * rule.up))
            columns = list(zip(*found)) or [[], [], []]
            kinds = (pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["a", "b", "linked"])

    texts = asked.select("block", "sizes", "payload", "asked").mapInArrow(fetch, "a long, salt long, rid long, text binary")
    # The leader of a group comes first.
    ordered = texts.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("rid") != F.col("a"))
    return settled(ordered.mapInArrow(compare, "a long, b long, linked boolean"), "tested")
