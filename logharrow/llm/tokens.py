"""Token counts without shuffling pre-tokens: a frequent-word table, then worker caches."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from logharrow.llm.common import id_and_text, map_texts

# The sign that stands for a space inside pieces.
SPACE = "▁"
# Pre-tokens in the broadcast table, and the longest of them in characters: at most 10 MB.
TABLE_SIZE = 32_768
TABLE_LENGTH = 64
# Documents of the sample frequent pre-tokens are chosen from, and how many of each count.
SAMPLED = 4_000
PER_DOCUMENT = 512
# Lengths of rarer pre-tokens kept by a worker.
CACHED = 400_000
# A pre-token behind a run of spaces, or a run of spaces at the end.
RUNS = re.compile(" *[^ ]+| +")


@lru_cache(4)
def model(path: str) -> tuple[sentencepiece.SentencePieceProcessor, bool]:
    """The tokenizer, and whether texts may be cut before each space.

    They may if no piece holds a space behind another character: merges then never
    cross such a place, and the tokenizer puts a space before what it is given.
    """
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = map(sp.id_to_piece, range(sp.get_piece_size()))
    plain = sp.normalize("  Aéﬁ ") == SPACE * 3 + "Aéﬁ" + SPACE
    return sp, plain and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)


def pre_tokens(text: str) -> list[str]:
    """Parts of a text, each without the one space that is put before it."""
    text = text.replace(SPACE, " ")
    parts = text.split(" ")
    if "" in parts:  # runs of spaces stay with the word behind them
        return [part[1:] for part in RUNS.findall(" " + text)] if text else []
    return parts


class Lengths(dict):
    """Tokens by pre-token: the broadcast table, then what this worker has met, then the model."""

    def __init__(self, table: dict[str, int], sp: sentencepiece.SentencePieceProcessor):
        super().__init__(table)
        self.sp, self.met = sp, {}

    def __missing__(self, part: str) -> int:
        n = self.met.get(part)
        if n is None:
            # An empty part is a lone space at the end of the text.
            n = len(self.sp.encode(part)) if part else len(self.sp.encode("a ")) - len(self.sp.encode("a"))
            if len(part) <= TABLE_LENGTH:
                if len(self.met) >= CACHED:
                    self.met.clear()
                self.met[part] = n
        return n


def frequent_pre_tokens(docs: DataFrame, size: int = TABLE_SIZE, sampled: int = SAMPLED) -> list[str]:
    """The most frequent pre-tokens of a sample of about ``sampled`` documents (id, text).

    The choice affects speed alone, never a count of tokens, so it is made on a bounded sample
    and no pre-token is shuffled: a task counts its documents of the sample, of each the
    PER_DOCUMENT most frequent pre-tokens, and the driver adds the counts up.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                own = Counter(p for p in pre_tokens(value.as_py()) if len(p) <= TABLE_LENGTH)
                seen.update(dict(own.most_common(PER_DOCUMENT)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["part", "n"]
        )

    rows = docs.count()
    chosen = docs if rows <= sampled else docs.sample(sampled / rows, seed=1)
    counts = chosen.select("text").mapInArrow(count, "part string, n long").toArrow()
    total: Counter = Counter()
    for part, n in zip(counts["part"].to_pylist(), counts["n"].to_pylist()):
        total[part] += n
    return [part for part, _ in total.most_common(size)]


def token_counts(
    docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Tokens of every whole text, as the tokenizer gives them for the text in one piece.

    Returns ``id_col``, n_bytes, n_tokens, over_limit; one row per row of ``docs``. NULL and
    empty texts have no bytes and no tokens. Other columns are not read. A model whose
    pieces span spaces is applied to whole texts instead.
    """
    source = id_and_text(docs, id_col, text_col)
    sp, cut = model(model_path)
    table: dict[str, int] = {}
    if cut:
        words = frequent_pre_tokens(source)  # TABLE_SIZE at most
        known = Lengths({}, sp)
        table = {word: known[word] for word in words}
    shared = source.sparkSession.sparkContext.broadcast(table)

    def begin():
        sp, _ = model(model_path)
        lengths = Lengths(shared.value, sp)

        def row(text: str) -> tuple:
            size = len(text.encode())
            n = sum(map(lengths.__getitem__, pre_tokens(text))) if cut else len(sp.encode(text))
            return size, (n if text else 0), n > limit

        return row

    rows = map_texts(source, begin, "id long, n_bytes long, n_tokens long, over_limit boolean")
    return rows.withColumnRenamed("id", id_col) if id_col != "id" else rows
