"""Documents in compressed blocks, read again and again without shuffling their texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from logharrow.llm.common import id_and_text
from logharrow.session import work_dir

# Bytes of text in a block; a longer text has a block of its own.
BLOCK_BYTES = 2 << 20
# Bits of a row number for the place in a block, and of a block number for the place in a task.
PLACE_BITS = 22
ORDINAL_BITS = 20
SCHEMA = "block long, ids array<long>, sizes array<long>, payload binary"


def block_table(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All documents as rows (block, ids, sizes, payload), in a table bucketed by ``block``.

    A payload is the zstd-compressed UTF-8 texts one behind the other. The table is
    written once to the shared folder, so block numbers stay what they are, and later joins
    by block shuffle only what is joined to it. A document's row number, ``rid``, is the
    block's number and its place; NULL and repeated ids are thus no trouble.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdCompressor(3)
        task, done = TaskContext.get().partitionId(), 0
        ids: list = []
        texts: list[bytes] = []
        held = 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([task << ORDINAL_BITS | done], pa.int64()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                    pa.array([zstd.compress(b"".join(texts))], pa.binary()),
                ],
                names=["block", "ids", "sizes", "payload"],
            )

        for batch in batches:
            keys, values = batch.column(0), batch.column(1)
            for i in range(len(keys)):
                text = values[i].as_py().encode()
                if texts and (held + len(text) > block_bytes or len(texts) >= 1 << PLACE_BITS):
                    yield block()
                    done, held = done + 1, 0
                    ids, texts = [], []
                ids.append(keys[i].as_py())
                texts.append(text)
                held += len(text)
        if texts:
            yield block()

    spark = docs.sparkSession
    source = id_and_text(docs, id_col, text_col)
    blocks = source.mapInArrow(pack, SCHEMA)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"blocks_{uuid.uuid4().hex}"
    (
        blocks.repartition(n, "block")
        .write.bucketBy(n, "block")
        .option("compression", "none")
        .saveAsTable(name, format="parquet", path=work_dir(spark, "blocks"))
    )
    return spark.table(name)


def rids(block: int, n: int) -> np.ndarray:
    return (np.int64(block) << PLACE_BITS) + np.arange(n, dtype=np.int64)


def unpack(payload: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(payload) if payload else b""
