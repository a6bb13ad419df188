"""Vectorised 64-bit hashes of words, shingles and byte windows."""

from __future__ import annotations

import numpy as np

U = np.uint64
# A fixed generator for the hash constants, so that all workers agree.
_DRAW = np.random.default_rng(20240229)
_BYTE = _DRAW.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_STEP = [U(int(x) << 1 | 1) for x in _DRAW.integers(0, 2**62, 80, dtype=np.uint64)]
_BASE = 0x9E3779B97F4A7C17  # 3 modulo 4
_INVERSE = pow(_BASE, -1, 2**64)

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers one to one."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = BLANK[data]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of each word from running sums, so that no word is touched alone."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), out=sums[1:])
    back = _powers(_INVERSE, len(data) + 1)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(data: bytes, sizes: list[int], n: int, piece: int = 1 << 20) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text of a block, A-Z lower-cased.

    A text with fewer words has its whole sequence as one shingle; one without words none.
    Long texts are hashed in pieces cut between words, so memory stays bounded.
    """
    out, at = [], 0
    whole = np.frombuffer(data, np.uint8)
    group: list[int] = []
    start = 0
    for size in [*sizes, None]:
        if group and (size is None or at - start + size > piece):
            out += _group_sets(whole[start:at], group, n)
            start, group = at, []
        if size is not None:
            group.append(size)
            at += size
    return out


def _group_sets(data: np.ndarray, sizes: list[int], n: int, piece: int = 4 << 20) -> list[np.ndarray]:
    if len(data) > piece:  # one long text
        return [_shingles(_long_hashes(data, piece), n)]
    cuts = np.cumsum(sizes)
    # A blank behind each text keeps its last word from the next text.
    spread = np.insert(LOWER[data], cuts, 0x20)
    starts, ends = words(spread)
    hashes = word_hashes(spread, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    edges = np.searchsorted(starts, np.concatenate([[0], cuts + np.arange(1, len(cuts) + 1)]))
    return [_shingles(hashes[a:b], n) for a, b in zip(edges[:-1], edges[1:])]


def _long_hashes(data: np.ndarray, piece: int) -> np.ndarray:
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + piece)
        blanks = np.flatnonzero(BLANK[data[at:end]]) if end < len(data) else ()
        if end < len(data):
            # Cut at the last blank; a word longer than a piece makes the piece grow.
            while not len(blanks) and end < len(data):
                end = min(len(data), end + piece)
                blanks = np.flatnonzero(BLANK[data[at:end]])
            if end < len(data):
                end = at + int(blanks[-1]) + 1
        part = LOWER[data[at:end]]
        starts, ends = words(part)
        if len(starts):
            parts.append(word_hashes(part, starts, ends))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    if not len(hashes):
        return hashes
    k = min(n, len(hashes))
    total = np.full(len(hashes) - k + 1, U(k))
    for i in range(k):
        total = total * _STEP[i] + hashes[i : len(hashes) - k + 1 + i]
    return np.unique(mix(total))


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of every window of ``size`` bytes, built by doubling."""
    have, span, level = {1: _BYTE[data]}, 1, 0
    while 2 * span <= size:
        h = have[span]
        h = h[: len(h) - span] * _STEP[level] + h[span:]
        have[2 * span] = h ^ (h >> U(32))
        span, level = 2 * span, level + 1
    n, out, at = len(data) - size + 1, None, 0
    for s in sorted(have, reverse=True):
        if size - at >= s:
            part = have[s][at : at + n]
            out = part if out is None else out * _STEP[20 + level] + part
            at += s
    return mix(out)


def sliding(values: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over every ``size`` neighbours, by doubling."""
    span = 1
    while 2 * span <= size:
        values = pick(values[:-span], values[span:])
        span *= 2
    rest = size - span
    return pick(values[:-rest], values[rest:]) if rest else values
