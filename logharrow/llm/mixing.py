"""Mixing sources to target weights by pivotal dependent rounding over a reduction tree."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logharrow.llm.common import WORD
from logharrow.operators.lookup import lookup_join
from logharrow.session import settled

# Documents rounded one after the other in a slot, and slots joined at each level of the tree.
SLOT_ROWS = 8_192
FAN_IN = 16
# Copies of a document a mix may take at most.
MAX_COPIES = 2
EPSILON = 1e-9
ROW = "id long, size long, source string, key string, source_size long, target double, base int, p double, slot long"


def targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150) -> DataFrame:
    """Words to take of each source: (key, source_size, target), one row per source.

    Sources in code point order, NULL last, weigh ``weights`` over and over and share
    ``percent`` of all words. A target stops at MAX_COPIES times the source's words; what is
    over is shared by weight among the rest, until none is above. That level is found
    in one pass over the sources, ordered by how soon they fill up.
    """
    per = sized.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    per = per.withColumn("w", weight.cast("double")).withColumn("cap", F.col("source_size") * float(MAX_COPIES))
    filling = Window.orderBy(F.col("cap") / F.col("w"), "w", F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    behind = filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * (percent / 100)
    per = per.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(behind))
    full = F.col("cap") <= F.col("level") * F.col("w")
    per = per.withColumn("full", full).withColumn(
        "level", F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(
            filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        )
    )
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * F.col("level"))
    return per.select("key", "source_size", target.alias("target"))


def _rounded(rows: DataFrame, level: int, seed: int, last: bool) -> DataFrame:
    """One level of the tree: within each slot and source all but one fraction become 0 or 1.

    Two fractions p and q of documents of a and b words exchange words until one of
    them is 0 or 1; the direction is drawn so that each keeps its expectation. The words
    of the two together stay what they were, so only the one left over is still open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, draw, held = None, None, None
        for batch in batches:
            columns = batch.to_pydict()
            names = list(columns)
            done: list[tuple] = []
            for row in zip(*columns.values()):
                row = dict(zip(names, row))
                if group != (row["slot"], row["key"]):
                    if held:
                        done.append(close(held, draw))
                    group, held = (row["slot"], row["key"]), None
                    draw = random.Random(f"{seed}/{level}/{row['slot']}/{row['key']}")
                if row["size"] == 0 and not settled_at(row["p"]):
                    row["p"] = float(draw.random() < row["p"])  # no words to exchange
                if settled_at(row["p"]):
                    done.append(row)
                elif held is None:
                    held = row
                else:
                    exchange(held, row, draw)
                    for one, other in ((held, row), (row, held)):
                        if settled_at(one["p"]):
                            done.append(one)
                            held = None if settled_at(other["p"]) else other
                            if held is None:
                                done.append(other)
                            break
            yield pa.RecordBatch.from_pylist(done, schema=batch.schema)
            schema = batch.schema
        if held:
            yield pa.RecordBatch.from_pylist([close(held, draw)], schema=schema)

    def close(row: dict, draw: random.Random) -> dict:
        if last:
            row["p"] = float(draw.random() < row["p"])
        return row

    ordered = rows.repartition("slot").sortWithinPartitions("slot", "key", "id", "size", "p")
    return ordered.mapInArrow(run, ROW)


def settled_at(p: float) -> bool:
    return p < EPSILON or p > 1 - EPSILON


def exchange(one: dict, two: dict, draw: random.Random) -> None:
    a, b, p, q = one["size"], two["size"], one["p"], two["p"]
    up, down = min((1 - p) * a, q * b), min(p * a, (1 - q) * b)
    words = up if draw.random() * (up + down) < down else -down
    for row, moved, size in ((one, words, a), (two, -words, b)):
        value = row["p"] + moved / size
        row["p"] = float(round(value)) if settled_at(value) else value


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, seed: int = 1,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Copies of each document such that the sources' words meet their targets.

    Returns ``id_col``, ``source_col``, size, source_size, target, copies (0 to MAX_COPIES), taken
    (copies times size); one row per row of ``docs``. All documents of a source have the same
    expected number of copies; a source's taken words miss its target by less than the size
    of one document. NULL sources are a source, NULL texts have no words. The result
    depends on rows and seed alone, not on how the table is split: rows meet in slots by a hash
    of id and size, in order. A source of any share is spread over all slots. Repeated
    rows are rows of their own. The table of sources is broadcast only up to a checked size.
    """
    sized = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("="), source_col), F.lit("")).alias("key"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
    )
    sized = settled(sized, "sizes")
    rows = lookup_join(sized, settled(targets(sized, weights, percent), "targets"), "key")
    ratio = F.least(
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)),
        F.lit(float(MAX_COPIES)),
    )
    slots = FAN_IN
    while slots * SLOT_ROWS < sized.count():
        slots *= FAN_IN
    slot = F.pmod(F.xxhash64("id", "size"), F.lit(slots)).cast("long")
    level = rows.select(
        "id", "size", "source", "key", "source_size", "target", F.floor(ratio + EPSILON).cast("int").alias("base"),
        F.greatest(ratio - F.floor(ratio + EPSILON), F.lit(0.0)).alias("p"), slot.alias("slot"),
    )
    depth, closed = 0, None
    while True:
        level = settled(_rounded(level, depth, seed, last=slots == 1), "rounded")
        open_rows = (F.col("p") >= EPSILON) & (F.col("p") <= 1 - EPSILON)
        done = level.where(~open_rows)
        closed = done if closed is None else closed.unionByName(done)
        if slots == 1:
            break
        slots, depth = slots // FAN_IN, depth + 1
        level = level.where(open_rows).withColumn("slot", F.pmod("slot", F.lit(slots)).cast("long"))
    copies = (F.col("base") + F.round("p").cast("int")).alias("copies")
    return closed.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies,
        (copies * F.col("size")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: every row of ``docs``, all its columns, as many times as it has copies.

    Rows that share id, source and size are told apart by a number on both sides.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    keys = ["_id", "_source", "_size"]

    def keyed(df: DataFrame, size, *columns) -> DataFrame:
        own = F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id")
        source = F.coalesce(F.concat(F.lit("="), source_col), F.lit("")).alias("_source")
        return df.select(own, source, size.alias("_size"), *columns)

    def numbered(df: DataFrame, order) -> DataFrame:
        return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))

    taken = mix_sources(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    # The number is a key too: rows that share the rest meet one to one, however many they are.
    taken = numbered(keyed(taken, F.col("size"), F.col("copies").alias("_copies")), F.desc("_copies"))
    rows = numbered(keyed(docs, size, F.struct(*docs.columns).alias("_row")), F.xxhash64(F.col("_row")[text_col]))
    both = rows.join(taken.where("_copies > 0"), [*keys, "_n"])
    return both.select("_row", F.explode(F.sequence(F.lit(1), "_copies"))).select("_row.*")
