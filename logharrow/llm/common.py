"""What the corpus operators share: words, tables, one-to-one work on documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

# A word is a run of characters other than the space and the five controls after it.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]"
# Rows a worker gives back at a time, however many it was given.
OUT_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, as ``id`` and ``text``; a NULL text is empty."""
    return df.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def map_texts(
    df: DataFrame, begin: Callable[[], Callable[[str], tuple]], schema: str
) -> DataFrame:
    """One output row per document: ``id`` and what the function makes of the text.

    ``begin`` runs once in each task and returns the function; documents stay in the
    partitions of the scan. Texts are taken out of the Arrow batch one at a time, and rows go
    back in small batches, so a worker holds little besides the batch it reads.
    """
    out = df.sparkSession.createDataFrame([], schema).schema
    kinds = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = begin()
        for batch in batches:
            for start in range(0, max(batch.num_rows, 1), OUT_ROWS):
                part = batch.slice(start, OUT_ROWS)
                ids, texts = part.column(0), part.column(1)
                rows = [fn(texts[i].as_py()) for i in range(len(ids))]
                columns = list(zip(*rows)) if rows else [[] for _ in kinds.names[1:]]
                arrays = [pa.array(column, kind.type) for column, kind in zip(columns, list(kinds)[1:])]
                yield pa.RecordBatch.from_arrays([ids, *arrays], names=kinds.names)

    return df.select("id", "text").mapInArrow(run, out)
