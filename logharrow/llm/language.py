"""Language of texts by a linear-chain conditional random field over their words.

Every word gets a score for each language from its affixes, its byte n-grams, itself and a
lexicon; learned transitions say how likely the language stays or changes from one word to the
next. Forward-backward turns both into the probability of each language at each word, also
where a text switches between languages; a text's language is the one its words expect most.

The field is fitted on a bounded sample of labelled texts: runs of words of different texts are put one
behind the other, so that the transitions see switches. The lexicon is counted over all labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logharrow.session import settled

UNKNOWN = "und"
# Weights of hashed features, and slots of the lexicon; both are sent to every task.
FEATURE_BITS = 16
LEXICON_BITS = 16
# Words between which forward-backward hands over, and bytes of text whose features are computed at once.
SEGMENT = 256
PIECE_BYTES = 1 << 18
GROUP_BYTES = 1 << 20
# Groups in which a language's texts are cut to those of least hash before they meet.
SALTS = 64

_LETTER = regex.compile(r"\p{L}")
U = np.uint64
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[ord("a") : ord("z") + 1] = True
_WORD_BYTE[0x80:] = True
_MULTIPLIER = U(0x9E3779B97F4A7C15)
_STEP = U(0x100000001B3)


@dataclass(frozen=True)
class Training:
    """The sample that is fitted, and how.

    At most ``per_language`` different texts of a language, those of least hash; of each at most
    ``words`` words, in runs spread over the whole text. They are dealt out to ``shards`` tasks, whose
    weights are averaged after each of ``rounds``.
    """

    per_language: int = 400
    words: int = 600
    shards: int = 8
    rounds: int = 3
    run: int = 64
    sequence: int = 64
    batch: int = 32
    rate: float = 0.3
    ridge: float = 1e-4


@dataclass(frozen=True)
class LanguageModel:
    """Labels in order, weights of features, of the lexicon and of transitions, and the lexicon itself."""

    labels: list[str]
    weights: np.ndarray  # 2 ** FEATURE_BITS x labels
    reliance: np.ndarray  # labels x labels: how far the lexicon's hints count
    moves: np.ndarray  # labels x labels
    lexicon: np.ndarray  # 2 ** LEXICON_BITS x labels


def folded(text: str) -> str:
    """Lower-cased, letter by letter where the text would change its length."""
    lower = text.lower()
    if len(lower) != len(text):
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return lower


def _pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of a text of about PIECE_BYTES, cut where no word is."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + PIECE_BYTES)
        while end < n:
            gaps = np.flatnonzero(~_WORD_BYTE[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
                break
            end = min(n, end + PIECE_BYTES)
        yield at, end
        at = end


def _joined(texts: list[bytes]) -> np.ndarray:
    """Folded texts one behind the other; no word spans two."""
    return np.frombuffer(b"\n".join(texts), np.uint8)


@dataclass
class Words:
    """The words of a piece of text and their features."""

    starts: np.ndarray
    ends: np.ndarray
    grams: np.ndarray  # features of all letters, word by word, three in a row for each letter
    first: np.ndarray  # where each word's letters begin
    own: np.ndarray  # words x 5: affixes of two sizes, and the word
    slots: np.ndarray  # in the lexicon


def _slot(h: np.ndarray, kind: int, bits: int) -> np.ndarray:
    return ((h + U(kind)) * _MULTIPLIER >> U(64 - bits)).astype(np.int64)


def _bounds(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where the words of folded bytes are: letters, others 0, with two zeros at either end; starts, ends, places of letters,
    and where each word's letters begin among those."""
    letter = np.zeros(len(data) + 4, bool)
    letter[2:-2] = _WORD_BYTE[data]
    d = np.zeros(len(letter), np.uint8)
    d[2:-2] = data
    d[~letter] = 0
    starts, ends = (np.flatnonzero(x) + 1 for x in (letter[1:] & ~letter[:-1], letter[:-1] & ~letter[1:]))
    sizes = ends - starts
    return d, starts, ends, np.flatnonzero(letter), np.cumsum(sizes) - sizes


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of _STEP and of its inverse, which a fixed odd base has."""
    if len(_POWERS[0]) >= n:
        return _POWERS
    made = []
    for base in (_STEP, U(pow(int(_STEP), -1, 2**64))):
        powers = np.full(n, base, np.uint64)
        powers[0] = 1
        made.append(np.cumprod(powers, dtype=np.uint64))
    if n <= 4 * PIECE_BYTES:  # those of a huge word are not kept
        _POWERS[:] = made
    return made


def _hashes(d: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each whole word: sums of powers."""
    powers, inverse = _powers(len(at) + 1)
    sums = np.zeros(len(at) + 1, np.uint64)
    np.cumsum((d[at].astype(np.uint64) + U(1)) * powers[: len(at)], out=sums[1:])
    whole = (sums[first + (ends - starts)] - sums[first]) * inverse[first] + (ends - starts).astype(np.uint64)
    return (whole ^ (whole >> U(29))) * U(0xBF58476D1CE4E5B9)


def _representatives(d: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, first: np.ndarray, whole: np.ndarray):
    """The first of equal words, and for each word which of those it equals; letters are compared, not hashes alone."""
    _, chosen, same = np.unique(whole, return_index=True, return_inverse=True)
    sizes, head = ends - starts, chosen[same]
    if (sizes == sizes[head]).all():
        moved = np.repeat(starts[head] - starts, sizes)
        if (d[at] == d[at + moved]).all():
            return chosen, same
    return np.arange(len(starts)), np.arange(len(starts))


def distinct_words(data: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The different words of folded bytes with their features, and of every word which it is, its start and its end.

    All features of a word come from its own letters, so they are computed once for equal words.
    """
    d, starts, ends, at, first = _bounds(data)
    whole = _hashes(d, starts, ends, at, first)
    chosen, same = _representatives(d, starts, ends, at, first, whole)
    sizes = (ends - starts)[chosen]
    heads = np.cumsum(sizes) - sizes
    letters = np.repeat(starts[chosen] - heads, sizes) + np.arange(sizes.sum())
    return _features(d, starts[chosen], ends[chosen], letters, heads, whole[chosen]), same, starts - 2, ends - 2


def word_slots(data: np.ndarray) -> np.ndarray:
    """The lexicon's slots of all words of folded bytes."""
    return _slot(_hashes(*_bounds(data)), 9, LEXICON_BITS)


def words_of(data: np.ndarray) -> Words:
    """Words (runs of letters a-z and of characters beyond ASCII) of folded UTF-8 bytes."""
    d, starts, ends, at, first = _bounds(data)
    return _features(d, starts, ends, at, first, _hashes(d, starts, ends, at, first))


def _features(d: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, first: np.ndarray, whole: np.ndarray) -> Words:
    d = d.astype(np.uint64)
    two = d[at] * _STEP + d[at + 1]
    three = d[at - 1] * _STEP * _STEP + two
    four = three * _STEP + np.where(d[at + 1] > 0, d[at + 2], U(0))
    grams = np.stack([_slot(two, 1, FEATURE_BITS), _slot(three, 2, FEATURE_BITS), _slot(four, 3, FEATURE_BITS)], 1)
    def affix(a: np.ndarray, n: int) -> np.ndarray:
        h = np.zeros(len(starts), np.uint64)
        for k in range(n):
            place = a + k
            inside = (place >= starts) & (place < ends)
            h = h * _STEP + np.where(inside, d[np.clip(place, 0, len(d) - 1)], U(0))
        return h

    own = [_slot(affix(starts, 2), 4, FEATURE_BITS), _slot(affix(starts, 4), 5, FEATURE_BITS)]
    own += [_slot(affix(ends - 2, 2), 6, FEATURE_BITS), _slot(affix(ends - 4, 4), 7, FEATURE_BITS), _slot(whole, 8, FEATURE_BITS)]
    return Words(starts - 2, ends - 2, grams, first, np.stack(own, 1), _slot(whole, 9, LEXICON_BITS))


def emissions(words: Words, model: LanguageModel) -> np.ndarray:
    """Words x labels: what the features of each word say."""
    if not len(words.starts):
        return np.zeros((0, len(model.labels)))
    w = model.weights
    letters = w[words.grams[:, 0]] + w[words.grams[:, 1]] + w[words.grams[:, 2]]
    score = np.add.reduceat(letters, words.first).astype(np.float64)
    for k in range(words.own.shape[1]):
        score += w[words.own[:, k]]
    return score + model.lexicon[words.slots] @ model.reliance


# Forward-backward over many sequences at once, sorted by length, longest first. Arrays are places x
# sequences x labels; ``entry`` is what the word before says of the first, ``exit`` what follows the last.


def _active(lengths: np.ndarray) -> np.ndarray:
    """How many sequences have a word at each place."""
    places = int(lengths[0]) if len(lengths) else 0
    return np.searchsorted(-lengths, -np.arange(places), "left")


def forward_backward(e: np.ndarray, moves: np.ndarray, lengths: np.ndarray, entry: np.ndarray, exit: np.ndarray):
    """Forward and backward vectors of each place, each scaled to sum 1."""
    n = _active(lengths)
    ahead, back = np.zeros_like(e), np.ones_like(e)
    for t in range(len(n)):
        k = n[t]
        x = entry[:k] if t == 0 else ahead[t - 1, :k] @ moves
        x = x * e[t, :k]
        ahead[t, :k] = x / x.sum(axis=1, keepdims=True)
    for t in range(len(n) - 1, -1, -1):
        k = n[t + 1] if t + 1 < len(n) else 0
        if k:
            x = (e[t + 1, :k] * back[t + 1, :k]) @ moves.T
            back[t, :k] = x / x.sum(axis=1, keepdims=True)
        back[t, k : n[t]] = exit[k : n[t]]
    return ahead, back


def _transfers(e: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each sequence the matrix that takes its ``entry`` to the forward vector of its last word."""
    n, labels = _active(lengths), e.shape[2]
    out = np.zeros((e.shape[1], labels, labels))
    out[:, range(labels), range(labels)] = e[0]
    for t in range(1, len(n)):
        x = (out[: n[t]] @ moves) * e[t, : n[t], None, :]
        out[: n[t]] = x / x.sum(axis=(1, 2), keepdims=True)
    return out


def _odds(score: np.ndarray) -> np.ndarray:
    return np.exp(np.maximum(score - score.max(axis=-1, keepdims=True), -60.0))


def marginals(texts: list[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    """Words x labels of probabilities for each text, from its emissions; exact for texts of any length.

    Long texts are cut into segments that are worked on side by side: a matrix for each segment first,
    from which follows what enters and leaves it, then the words within.
    """
    labels = len(moves)
    moves = _odds(moves.reshape(1, -1)).reshape(moves.shape)
    cuts = [(i, a, min(a + SEGMENT, len(x))) for i, x in enumerate(texts) for a in range(0, len(x), SEGMENT)]
    if not cuts:
        return [np.zeros((0, labels)) for _ in texts]
    order = sorted(range(len(cuts)), key=lambda c: cuts[c][1] - cuts[c][2])
    place = {c: k for k, c in enumerate(order)}
    lengths = np.array([cuts[c][2] - cuts[c][1] for c in order])
    e = np.ones((lengths[0], len(cuts), labels))
    for k, c in enumerate(order):
        i, a, b = cuts[c]
        e[: b - a, k] = _odds(texts[i][a:b])
    entry, exit = np.ones((len(cuts), labels)), np.ones((len(cuts), labels))
    joined = [c for c in range(1, len(cuts)) if cuts[c][0] == cuts[c - 1][0]]
    if joined:
        parts = sorted({place[c] for j in joined for c in (j - 1, j)})
        through = dict(zip(parts, _transfers(e[:, parts], moves, lengths[parts])))
        for c in joined:
            x = entry[place[c - 1]] @ through[place[c - 1]] @ moves
            entry[place[c]] = x / x.sum()
        for c in reversed(joined):
            x = moves @ (through[place[c]] @ exit[place[c]])
            exit[place[c - 1]] = x / x.sum()
    ahead, back = forward_backward(e, moves, lengths, entry, exit)
    p = ahead * back
    p /= np.maximum(p.sum(axis=2, keepdims=True), 1e-300)
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for c, (i, a, b) in enumerate(cuts):
        out[i].append(p[: b - a, place[c]])
    return [np.concatenate(x) if x else np.zeros((0, labels)) for x in out]


# Fitting.


def _fitted(model: LanguageModel, examples: list[tuple[int, str]], how: Training, seed: int) -> tuple[LanguageModel, int]:
    """One pass of stochastic gradient steps over a shard's texts; the words seen."""
    draw, k = np.random.default_rng(seed), len(model.labels)
    feature, slots, label, size = [], [], [], []
    runs: list[np.ndarray] = []
    at = 0
    for own, text in examples:
        x = words_of(np.frombuffer(folded(text).encode(), np.uint8))
        n = len(x.starts)
        counts = np.diff(np.r_[x.first, len(x.grams)])
        grams = np.split(x.grams, x.first[1:]) if n else []
        chosen = np.arange(n)
        if n > how.words:  # runs spread over the text
            heads = np.arange(how.words // how.run) * n // (how.words // how.run)
            chosen = np.unique((heads[:, None] + np.arange(how.run)).ravel())
            chosen = chosen[chosen < n]
        for i in chosen:
            feature.append(np.concatenate([grams[i].ravel(), x.own[i]]))
        slots.append(x.slots[chosen])
        size.append(3 * counts[chosen] + x.own.shape[1])
        label.append(np.full(len(chosen), own))
        end = at + len(chosen)
        while at < end:
            step = min(end - at, 1 << int(draw.integers(0, how.run.bit_length())))
            runs.append(np.arange(at, at + step))
            at += step
    if not at:
        return model, 0
    slots, label, size = np.concatenate(slots), np.concatenate(label), np.concatenate(size)
    flat, starts = np.concatenate(feature), np.cumsum(size) - size
    order = np.concatenate([runs[i] for i in draw.permutation(len(runs))])
    length = min(how.sequence, len(order))
    order = order[: len(order) // length * length].reshape(-1, length)
    weights, reliance, moves = model.weights.astype(np.float64), model.reliance.copy(), model.moves.copy()
    seen = [np.full_like(x, 1e-3) for x in (weights, reliance, moves)]
    for first in range(0, len(order), how.batch):
        rows = order[first : first + how.batch]
        b, words = len(rows), rows.T.ravel()  # by place, then sequence
        idx = np.concatenate([flat[starts[w] : starts[w] + size[w]] for w in words])
        heads = np.cumsum(size[words]) - size[words]
        hints = model.lexicon[slots[words]]
        score = np.add.reduceat(weights[idx], heads) + hints @ reliance
        e = _odds(score).reshape(length, b, k)
        odds = _odds(moves.reshape(1, -1)).reshape(k, k)
        ahead, back = forward_backward(e, odds, np.full(b, length), np.ones((b, k)), np.ones((b, k)))
        p = ahead * back
        p /= p.sum(axis=2, keepdims=True)
        truth = label[words].reshape(length, b)
        lift = -p
        lift[np.arange(length)[:, None], np.arange(b)[None], truth] += 1
        pair = ahead[:-1, :, :, None] * odds * (e[1:] * back[1:])[:, :, None, :]
        pair /= np.maximum(pair.sum(axis=(2, 3), keepdims=True), 1e-300)
        moved = -pair.sum(axis=(0, 1))
        np.add.at(moved, (truth[:-1].ravel(), truth[1:].ravel()), 1)
        lift = lift.reshape(-1, k)
        by_feature = np.repeat(lift, size[words], axis=0)
        grown = np.stack([np.bincount(idx, by_feature[:, j], len(weights)) for j in range(k)], 1)
        steps = (grown, hints.T @ lift, moved)
        for value, gradient, squares in zip((weights, reliance, moves), steps, seen):
            gradient = gradient / (b * length) - how.ridge * value
            squares += gradient * gradient
            value += how.rate * gradient / np.sqrt(squares)
    return replace(model, weights=weights.astype(np.float32), reliance=reliance, moves=moves), order.size


def _lexicon(labelled: DataFrame, labels: list[str]) -> np.ndarray:
    """How much more common the words of each slot are in a language than on average, over all texts."""
    number = {label: i for i, label in enumerate(labels)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        waiting: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def count(label: str) -> None:
            counts = held.setdefault(label, np.zeros(1 << LEXICON_BITS, np.int64))
            data = _joined(waiting.pop(label))
            for a, b in _pieces(data):
                counts += np.bincount(word_slots(data[a:b]), minlength=len(counts))
            sizes[label] = 0

        for batch in batches:
            for label, text in zip(batch.column(0), batch.column(1)):
                label, text = label.as_py(), folded(text.as_py()).encode()
                waiting.setdefault(label, []).append(text)
                sizes[label] = sizes.get(label, 0) + len(text)
                if sizes[label] >= PIECE_BYTES:  # short texts of a language are counted together
                    count(label)
        for label in list(waiting):
            count(label)
        for label, counts in held.items():
            slots = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number[label]], pa.int32()), pa.array([slots], pa.list_(pa.int64())),
                    pa.array([counts[slots]], pa.list_(pa.int64())),
                ],
                names=["label", "slot", "n"],
            )

    tasks = labelled.select("lang", "text").mapInArrow(run, "label int, slot array<long>, n array<long>")
    each = tasks.select("label", F.explode(F.arrays_zip("slot", "n")).alias("x")).select("label", "x.slot", "x.n")
    rows = each.groupBy("label", "slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((1 << LEXICON_BITS, len(labels)))
    counts[rows["slot"].to_numpy(), rows["label"].to_numpy()] = rows["n"].to_numpy()
    share = (counts + 0.5) / (counts.sum(axis=0) + 0.5 * len(counts))
    return np.clip(np.log(share / share.mean(axis=1, keepdims=True)) / 4, -1.5, 1.5).astype(np.float32)


def fit_language_model(docs: DataFrame, how: Training = Training(), text_col: str = "text", lang_col: str = "lang") -> LanguageModel | None:
    """A model from the rows with a text and a language; None where there are none.

    Which rows may be learned from is the caller's choice. Copies of a text are fitted once.
    """
    labelled = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where(
        "lang IS NOT NULL AND text IS NOT NULL"
    )
    marks = labelled.select("lang", F.xxhash64("text").alias("mark")).distinct()
    # In groups by hash first, so that what meets for a language is bounded whatever the table's size.
    for group in (["lang", F.pmod("mark", F.lit(SALTS))], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*group).orderBy("mark"))
        marks = marks.withColumn("rank", rank).where(F.col("rank") <= how.per_language).drop("rank")
    marks = settled(marks, "marks")
    labels = sorted(r.lang for r in marks.select("lang").distinct().collect())
    if not labels:
        return None
    marked = labelled.withColumn("mark", F.xxhash64("text")).join(F.broadcast(marks), ["lang", "mark"])
    chosen = marked.groupBy("lang", "mark").agg(F.min("text").alias("text"))
    shard = F.pmod(F.xxhash64("lang", "mark"), F.lit(how.shards)).cast("int")
    number = F.array_position(F.array(*map(F.lit, labels)), F.col("lang")).cast("int") - 1
    sample = settled(chosen.select(shard.alias("shard"), number.alias("label"), "mark", "text"), "sample")
    k = len(labels)
    model = LanguageModel(
        labels, np.zeros((1 << FEATURE_BITS, k), np.float32), np.eye(k), np.eye(k), _lexicon(labelled, labels)
    )
    for turn in range(how.rounds):
        model = _round(sample, model, how, turn)
    return model


def _round(sample: DataFrame, model: LanguageModel, how: Training, turn: int) -> LanguageModel:
    """Every shard goes on from the same weights; theirs are averaged by the words they saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                shards.setdefault(row["shard"], []).append((row["mark"], row["label"], row["text"]))
        for shard in sorted(shards):
            examples = [(label, text) for _, label, text in sorted(shards[shard])]
            fitted, n = _fitted(model, examples, how, shard + turn * how.shards)
            data = [x.astype(np.float32).tobytes() for x in (fitted.weights, fitted.reliance, fitted.moves)]
            yield pa.RecordBatch.from_pydict({"shard": [shard], "n": [n], "values": [b"".join(data)]})

    rows = sample.repartition(how.shards, "shard").mapInArrow(run, "shard long, n long, values binary")
    total, n = 0.0, 0
    for row in sorted(rows.collect(), key=lambda r: r.shard):
        total = total + np.frombuffer(row["values"], np.float32).astype(np.float64) * row["n"]
        n += row["n"]
    if not n:
        return model
    k = len(model.labels)
    weights, reliance, moves = np.split(total / n, np.cumsum([model.weights.size, k * k]))
    return replace(
        model, weights=weights.reshape(-1, k).astype(np.float32), reliance=reliance.reshape(k, k), moves=moves.reshape(k, k)
    )


# Applying.


def _text_emissions(text: str, model: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, starts and ends of words in them, and the words' emissions."""
    data = np.frombuffer(folded(text).encode(), np.uint8)
    return data, *_data_emissions(data, model)


def _data_emissions(data: np.ndarray, model: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of folded bytes, and their emissions."""
    starts, ends, scores = [], [], []
    for a, b in _pieces(data):
        words, same, begun, ended = distinct_words(data[a:b])
        starts.append(begun + a)
        ends.append(ended + a)
        scores.append(emissions(words, model).astype(np.float32)[same])
    if not scores:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(model.labels)))
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(scores)


def _each_emissions(texts: list[str], model: LanguageModel) -> list[np.ndarray]:
    """The emissions of each text's words, all texts looked at together."""
    whole = [folded(text).encode() for text in texts]
    starts, _, scores = _data_emissions(_joined(whole), model)
    ends = np.cumsum([len(x) + 1 for x in whole])
    return np.split(scores, np.searchsorted(starts, ends[:-1]))


def predict_language(
    docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The language of every row's text.

    Returns ``id_col``, lang_pred, score (the mean probability of that language over the words) and
    n_words. A text that is NULL or holds no letter, and every text where there is no model, is
    UNKNOWN with score 0; of equally expected languages the first by name is taken. Whole texts are
    read, by ``text_col`` alone; rows stay in the partitions of the scan.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, sizes = batch.column(0), batch.column(1), np.asarray(batch.column(2))
            done: list[tuple] = []
            group, held = [], 0
            # Texts of like length go through forward-backward together.
            order = np.argsort(sizes, kind="stable")
            for n, i in enumerate(order):
                text = texts[int(i)].as_py()
                if model is None or text is None or not _LETTER.search(text):
                    done.append((int(i), UNKNOWN, 0.0, 0))
                else:
                    group.append((int(i), text))
                    held += int(sizes[i])
                if group and (held >= GROUP_BYTES or n == len(order) - 1):
                    found = marginals(_each_emissions([x for _, x in group], model), model.moves)
                    for (at, _), p in zip(group, found):
                        mean = p.mean(axis=0)
                        best = int(np.argmax(mean))
                        done.append((at, model.labels[best], float(min(mean[best], 1.0)), len(p)))
                    group, held = [], 0
            taken = ids.take(pa.array([d[0] for d in done], pa.int64()))
            columns = list(zip(*done))[1:] if done else [[], [], []]
            kinds = (pa.string(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [taken, *[pa.array(c, kind) for c, kind in zip(columns, kinds)]], names=["id", "lang_pred", "score", "n_words"]
            )

    source = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).alias("size"),
    )
    out = source.mapInArrow(run, "id long, lang_pred string, score double, n_words long")
    return out.select(F.col("id").alias(id_col), "lang_pred", "score", "n_words")


def label_words(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where a text is in which language: ``id_col``, spans of (start, end, lang, words, score).

    A span is a run of words of the same most likely language; places are code points, ends
    exclusive. NULL texts and those without words have none.
    """
    schema = "id long, spans array<struct<start: long, end: long, lang: string, words: long, score: double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_spans(batch.column(1)[i].as_py() or "", model) for i in range(batch.num_rows)]
            spans = pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64(), "lang": pa.string(), "words": pa.int64(), "score": pa.float64()}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, spans)], names=["id", "spans"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, schema).select(F.col("id").alias(id_col), "spans")


def _spans(text: str, model: LanguageModel) -> list[dict]:
    data, starts, ends, scores = _text_emissions(text, model)
    if not len(starts):
        return []
    p = marginals([scores], model.moves)[0]
    best = p.argmax(axis=1)
    point = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    heads = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
    return [
        {
            "start": int(point[starts[a]]), "end": int(point[ends[b - 1]]), "lang": model.labels[best[a]],
            "words": int(b - a), "score": float(p[a:b, best[a]].mean()),
        }
        for a, b in zip(heads, np.r_[heads[1:], len(best)])
    ]
