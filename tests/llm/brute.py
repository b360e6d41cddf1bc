"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib

import xxhash

SPACE = " \t\n\v\f\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    found, now = [], ""
    for c in text or "":
        if c in SPACE:
            found, now = found + [now] * bool(now), ""
        else:
            now += c
    return found + [now] * bool(now)


def fingerprint(text, width=3):
    w = words(lower(text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_copies(rows, distance=3):
    """{doc_id: (hex, component)} of (doc_id, text) rows."""
    prints = {i: fingerprint(t) for i, t in rows}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def repeated_bytes(texts, length=400):
    """(n_removed, n_spans, sha256 of the rest) of each text."""
    data = [(t or "").encode() for t in texts]
    starts = {}
    for d, b in enumerate(data):
        for i in range(len(b) - length + 1):
            starts.setdefault(b[i : i + length], []).append((d, i))
    gone = [bytearray(len(b)) for b in data]
    for places in starts.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + length] = b"\1" * length
    found = []
    for b, g in zip(data, gone):
        spans = sum(1 for i in range(len(g)) if g[i] and (i == 0 or not g[i - 1]))
        rest = bytes(c for c, x in zip(b, g) if not x)
        found.append((sum(g), spans, hashlib.sha256(rest).hexdigest()))
    return found


def cut_text(text, length, starts):
    """The text without the bytes of repeated strings; characters covered in part stay."""
    data = text.encode()
    gone = bytearray(len(data))
    for i in range(len(data) - length + 1):
        if len(starts.get(data[i : i + length], ())) > 1:
            gone[i : i + length] = b"\1" * length
    left, at = "", 0
    for c in text:
        size = len(c.encode())
        if not all(gone[at : at + size]):
            left += c
        at += size
    return left


def cut_texts(texts, length=400):
    starts = {}
    for d, t in enumerate(texts):
        data = (t or "").encode()
        for i in range(len(data) - length + 1):
            starts.setdefault(data[i : i + length], []).append((d, i))
    return [None if t is None else cut_text(t, length, starts) for t in texts]


def plain_words(text):
    found, now = [], ""
    for c in lower(text or ""):
        if "0" <= c <= "9" or "a" <= c <= "z" or c >= "\x80":
            now += c
        else:
            found, now = found + [now] * bool(now), ""
    return found + [now] * bool(now)


def benchmark_hits(text, items, window=10):
    """(n_words, n_hit, sorted item ids) of a text; ``items`` are (id, text)."""
    w, hit, ids = plain_words(text), set(), set()
    for item, item_text in items:
        words_ = plain_words(item_text)
        n = min(window, len(words_))
        for j in range(len(words_) - n + 1) if n else ():
            for i in range(len(w) - n + 1):
                if w[i : i + n] == words_[j : j + n]:
                    hit.update(range(i, i + n))
                    ids.add("" if item is None else str(item))
    return len(w), len(hit), sorted(ids)


def mix(rows, seed="mix", weights=(5, 2, 1), volume=1.5, most=2, offsets=32):
    """(doc_id, size, source_size, target, copies) of (doc_id, text, source) rows."""
    import math

    sized = [(i, len(words(t)), s) for i, t, s in rows]
    sources = sorted({s for *_, s in sized}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for _, n, x in sized if x == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    capped, level = set(), 0.0
    while len(capped) < len(sources):
        level = (volume * sum(total.values()) - sum(most * total[s] for s in capped)) / sum(
            weight[s] for s in sources if s not in capped
        )
        more = {s for s in sources if most * total[s] <= weight[s] * level}
        if more <= capped:
            break
        capped = more
    found = []
    for s in sources:
        target = float(most * total[s]) if s in capped else weight[s] * level
        rate = target / total[s] if total[s] else 0.0
        name = f"{seed}:" + ("" if s is None else f"={s}")
        u = int(hashlib.md5(name.encode()).hexdigest()[:8], 16) / 2**32
        own = sorted((r for r in sized if r[2] == s), key=lambda r: (-r[1], r[0] is None, r[0] or 0))
        tried = [math.modf(u + j / offsets)[0] for j in range(offsets)]
        taken = lambda v, k: math.floor((k + 1) * rate + v) - math.floor(k * rate + v)
        apart = [abs(target - sum(taken(v, k) * n for k, (_, n, _) in enumerate(own))) for v in tried]
        best = tried[apart.index(min(apart))]
        found += [(i, n, total[s], target, taken(best, k)) for k, (i, n, _) in enumerate(own)]
    return found
