"""The operators once more, by plain loops, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def components(rows, n, up, down):
    """(id, text) rows to (id, set size, smallest linked id), sorted."""
    sets = []
    for _, text in rows:
        words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set())
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) * down >= len(a | b) * up and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    ids = defaultdict(list)
    for (key, _), g in zip(rows, group):
        ids[g].append(key)
    least = {g: min((k for k in keys if k is not None), default=None) for g, keys in ids.items()}
    return sorted(((k, len(s), least[g]) for (k, _), s, g in zip(rows, sets, group)), key=str)


def quality(text):
    text = text or ""
    words, lines = WORDS.findall(text), [x for x in text.split("\n") if WORDS.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(5)}
    n = len(words)
    failed = n < 10 or 100 * len(covered) > 20 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def luhn(digits):
    double = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in double) % 10 == 0


KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, d: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, d: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m, d: 16 <= len(d) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 8 <= len(d) <= 15),
}


def personal(text):
    spans = [
        (kind, m.start(), m.end())
        for kind, (pattern, good) in KINDS.items()
        for m in re.finditer(pattern, text or "")
        if good(m[0], re.sub("[^0-9]", "", m[0]))
    ]
    counts = tuple(sum(s[0] == kind for s in spans) for kind in KINDS)
    return *counts, sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))


def repeats(rows, length=50):
    """(id, text) rows to (id, bytes, removed, spans, digest of the rest), sorted."""
    last = float("inf")
    first: dict[bytes, float] = {}
    texts = [(last if k is None else k, k, (t or "").encode()) for k, t in rows]
    for key, _, data in texts:
        for i in range(len(data) - length + 1):
            part = data[i : i + length]
            first[part] = min(key, first.get(part, last))
    out = []
    for key, own, data in texts:
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < key:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((own, len(data), sum(gone), runs, sha(bytes(b for b, g in zip(data, gone) if not g))))
    return sorted(out, key=str)


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def lines(rows):
    """(id, text) rows to (id, lines, equal, near, digest of the rest), sorted."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen: list[str] = []
    out = []
    for i in order:
        key, text = rows[i]
        equal = near = 0
        kept = []
        for line in (text or "").split("\n"):
            if not WORDS.search(line):
                kept.append(line)
            elif line in seen:
                equal += 1
            else:
                if any(one_edit(line, other) for other in seen):
                    near += 1
                else:
                    kept.append(line)
                seen.append(line)
        out.append((key, (text or "").count("\n") + 1, equal, near, sha("\n".join(kept))))
    return sorted(out, key=str)


def targets(sizes: dict, weights=(5, 2, 1), share=1.5):
    """Words by source to target by source, by sharing out until nothing is over."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not full:
            return target | {s: left * weight[s] / total for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in full)
        open_ -= full
    return target
