"""Exact dedup against a persistent index of digests, bucketed and sorted by digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logharrow.llm.common import GAP
from logharrow.session import settled

# Buckets of a new index: one task reads one bucket, so choose about rows / 5 million.
BUCKETS = 64


def normalised(text: Column) -> Column:
    """The text without the six kinds of blanks; NULL counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), GAP + "+", "")


def digest_of(text_col: str) -> Column:
    return F.unhex(F.sha2(normalised(F.col(text_col)), 256))


class DigestIndex:
    """Digests of all texts kept so far, in a table of ``buckets`` buckets at ``path``.

    New rows meet it in a sort-merge anti-join for which only the new digests are
    shuffled; the table's side is read as it lies. What is new is appended, one file per
    bucket. A load has a name: repeating a load that was cut short gives the same answer.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = BUCKETS):
        self.spark, self.name, self.buckets = spark, name, buckets
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} "
            "(digest BINARY, keep_id BIGINT, group_size BIGINT, load STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, docs: DataFrame, load: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Deduplicates ``docs`` against the index and itself, and appends what is new.

        Of equal texts within the load, the one of most code points stays, then that of
        the smallest id (NULL ids last); all go if an earlier load has the text. Returns a
        row per row of ``docs``: ``id_col``, keep_id, group_size (equal rows in the load that
        brought the text), kept, text_sha256. Rows repeated with the same id and text share
        one answer. Texts are not shuffled, only digests. Other columns are not read.
        """
        text = F.coalesce(F.col(text_col), F.lit(""))
        rows = settled(
            docs.select(
                F.col(id_col).cast("long").alias("id"),
                digest_of(text_col).alias("digest"),
                F.length(text).cast("long").alias("n_chars"),
            ),
            "digests",
        )
        groups = rows.groupBy("digest").agg(
            F.max(F.struct("n_chars", F.bitwise_not("id").alias("reversed"))).alias("best"),
            F.count("*").alias("group_size"),
        )
        fresh = groups.hint("merge").join(self.rows().select("digest"), "digest", "left_anti")
        (
            fresh.select("digest", F.bitwise_not("best.reversed").alias("keep_id"), "group_size", F.lit(load).alias("load"))
            .repartition(self.buckets, "digest")
            .write.insertInto(self.name)
        )
        found = rows.hint("merge").join(self.rows(), "digest")
        return found.select(
            F.col("id").alias(id_col),
            "keep_id",
            "group_size",
            ((F.col("load") == load) & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )

    def new_documents(self, docs: DataFrame, load: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Adds ``docs`` and returns the rows that stay, with all their columns; of repeated rows one.

        Rows meet the kept ones by a hash of id and digest, so equal texts of many ids do
        not gather in a task.
        """
        kept = self.add(docs, load, id_col, text_col).where("kept").select(
            F.col(id_col).cast("long").alias("_id"), F.unhex("text_sha256").alias("_digest")
        )
        key = lambda c: F.xxhash64(c, "_digest")
        kept = kept.withColumn("_key", key(F.col("_id"))).select("_key", "_digest").distinct()
        rows = docs.select(F.struct(*docs.columns).alias("_row"), digest_of(text_col).alias("_digest"))
        rows = rows.withColumn("_key", key(F.col("_row")[id_col].cast("long")))
        rows = rows.join(kept, ["_key", "_digest"], "left_semi")
        once = Window.partitionBy("_key", "_digest").orderBy("_key")
        return rows.withColumn("_n", F.row_number().over(once)).where("_n = 1").select("_row.*")
