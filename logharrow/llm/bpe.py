"""Byte-level BPE: exact encoding in linear time, and decoding.

A piece of text is encoded by walking from longest matches and stepping back where two
neighbouring tokens could not stand side by side. Two tokens may be neighbours exactly
if the merges, applied to their joined bytes, keep the cut between them; that is found
by undoing merges on both sides of the cut and is memoised per pair of tokens.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from struct import pack

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharrow.llm.common import id_and_text, map_texts

# Pieces kept per worker, and the longest of them in characters.
CACHED_PIECES = 200_000
CACHED_LENGTH = 64
# Neighbour answers kept per worker.
CACHED_PAIRS = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Encodes and decodes byte strings with one table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no token for the bytes {missing[:5]}")
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.token_bytes = [self.bytes_of.get(i, b"") for i in range(self.size)]
        self.length = list(map(len, self.token_bytes))
        self.pairs: dict[int, bool] = {}
        self._split_tokens()
        self._match_tokens()

    def _split_tokens(self) -> None:
        """The last merge of every token that merging its own bytes gives back.

        Ranks are merge priorities, so all parts of a token were settled before it and
        merging its bytes by the ranks below its own leaves two parts or the token is
        never made by merges.
        """
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for rank in sorted(self.bytes_of):
            token = self.bytes_of[rank]
            if len(token) == 1:
                self.halves[rank] = (rank, rank)
                continue
            parts = self._merge(token, rank)
            if len(parts) == 2:
                self.halves[rank] = (parts[0], parts[1])
                self.joined[parts[0], parts[1]] = rank

    def _merge(self, token: bytes, below: int) -> list[int]:
        """Plain merging of a short byte string, by ranks under ``below``."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            rank, i = min(
                (self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))
            )
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _match_tokens(self) -> None:
        """The automaton that finds tokens, and for each token the next shorter one it starts with."""
        self.automaton = ahocorasick.Automaton()
        for rank in self.halves:
            self.automaton.add_word(self.bytes_of[rank].decode("latin-1"), rank)
        self.automaton.make_automaton()
        made = {self.bytes_of[rank]: rank for rank in self.halves}
        self.shorter: dict[int, int] = {}
        for token, rank in made.items():
            for cut in range(len(token) - 1, 0, -1):
                if token[:cut] in made:
                    self.shorter[rank] = made[token[:cut]]
                    break

    def _neighbours(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes keeps the cut between the two tokens.

        Merges are undone from the latest; the cut is lost if some pair that faced each
        other across it would have merged before the later of the two was made. At equal
        rank the merge further left comes first.
        """
        until = self.size + 1
        while True:
            rank = self.joined.get((left, right))
            if rank is not None and rank < until:
                return False
            first, second = self.halves[left][1], self.halves[right][0]
            if left > right and first != left or second == right:
                if first == left:
                    return True
                until, left = left, first
            else:
                until, right = right + 1, second

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size, length, pairs = len(piece), self.length, self.pairs
        # Matches come by increasing end, so the last one kept for a start is the longest.
        longest = {end + 1 - length[rank]: rank for end, rank in self.automaton.iter(piece.decode("latin-1"))}
        dead: set[int] = set()
        tokens: list[int] = []
        at, before, token = 0, -1, longest.get(0)
        while at < size:
            while token is not None:
                end = at + length[token]
                if end not in dead:
                    if before < 0:
                        break
                    fits = pairs.get(before << 32 | token)
                    if fits is None:
                        if len(pairs) >= CACHED_PAIRS:
                            pairs.clear()
                        fits = pairs[before << 32 | token] = self._neighbours(before, token)
                    if fits:
                        break
                token = self.shorter.get(token)
            if token is not None:
                tokens.append(token)
                at, before, token = end, token, longest.get(end)
            else:  # nothing fits here: give up the token before
                dead.add(at)
                token = tokens.pop()
                at -= length[token]
                before = tokens[-1] if tokens else -1
        return tokens

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


class Pieces(dict):
    """Ids of pieces, as packed little-endian unsigned 32-bit integers; a worker's cache."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        ids = self.codec.encode(piece.encode())
        ids = pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(4)
def tokenizer(path: str, pattern: str) -> tuple[Pieces, regex.Pattern]:
    """One per worker process and vocabulary."""
    return Pieces(Codec(read_ranks(path))), regex.compile(pattern)


def encode_text(text: str, path: str, pattern: str) -> np.ndarray:
    """The ids of a text. Bytes between matches of the pattern, if any, are not encoded."""
    pieces, split = tokenizer(path, pattern)
    return np.frombuffer(b"".join(map(pieces.__getitem__, split.findall(text))), "<u4")


def byte_bpe(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Ids of every whole text, and the digests of ids and of the bytes decoded from them.

    Returns ``id_col``, n_tokens, ids_sha256, decoded_sha256 and, with ``with_ids``, ids.
    One row per row of ``docs``, repeated ones too. A NULL or empty text has no tokens and
    the digest of no bytes. Other columns of ``docs`` are not read, whatever their names.
    The vocabulary is read on each worker from ``path``; texts stay where they are scanned.
    """

    def begin():
        pieces, _ = tokenizer(path, pattern)

        def row(text: str) -> tuple:
            packed = encode_text(text, path, pattern)
            ids = packed.tolist()
            back = pieces.codec.decode(ids)
            head = (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(back).hexdigest())
            return (*head, packed.view("<i4")) if with_ids else head

        return row

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    rows = map_texts(id_and_text(docs, id_col, text_col), begin, schema + ", ids array<int>" * with_ids)
    return rows.withColumnRenamed("id", id_col) if id_col != "id" else rows


def decode_ids(docs: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """Adds the text of a column of ids; NULL stays NULL. Bytes that are not UTF-8 become U+FFFD."""

    @F.pandas_udf("string")
    def decoded(column):
        codec = tokenizer(path, "").__getitem__(0).codec
        return column.map(lambda ids: None if ids is None else codec.decode(ids).decode("utf-8", "replace"))

    return docs.withColumn(text_col, decoded(ids_col))
