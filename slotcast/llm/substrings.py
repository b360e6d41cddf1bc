"""Removing repeated byte strings with suffix arrays.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts
elsewhere in the corpus, the same text included. Matches stay inside a text.

1. Anchors. A position is an anchor if its ``GRAM`` bytes hash lowest among all
   positions of some string of ``LENGTH`` bytes around it. Equal strings have
   equal lowest hashes, so only strings around an anchor whose hash occurs twice
   can repeat. The rest of a text (regions without such anchors) is left alone.
   Text that repeats itself closely has an anchor per period; of these only so
   many are kept that every string has one, each with the number it stands for.
2. Shards. The regions are dealt over shards in order of their least anchor
   hash, near copies side by side. A shard gets the suffix array of its bytes by
   Larsson-Sadakane refinement and the common prefixes of neighbours by Kasai's
   walk in text order. Starts that share ``LENGTH`` bytes with a neighbour are
   found; one start of each class stands for it in what follows.
3. Merging across shards. The string of a start is looked up among those of the
   other shards that have the same lowest anchor: the windows of one anchor hash
   meet in one task, which keeps the strings' 128-bit fingerprints sorted and
   finds each by binary search. An anchor with more than ``HOT`` occurrences
   does not meet in one task: its starts are rows that are counted by
   fingerprint instead.

Defined results: a null or empty text has no bytes and loses none; texts under
``LENGTH`` bytes are whole; repeated rows and copies repeat each other; null
ids keep their rows; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotcast.llm.store import settled, stored

LENGTH = 400
GRAM = 64
HOT = 8_000
SHARD_BYTES = 2 << 20
PIECE = 1 << 20

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_TOP = np.uint64(2**64 - 1)


# -- bytes ---------------------------------------------------------------------------------


def words_at(data: bytes) -> np.ndarray:
    """The eight bytes from every position as one number in byte order; zeros follow the end."""
    raw = np.frombuffer(data + bytes(8), np.uint8)
    rows = np.lib.stride_tricks.as_strided(raw, (len(data), 8), (1, 1))
    return np.ascontiguousarray(rows).view(">u8")[:, 0].astype(np.uint64)


def gram_of(length: int) -> int:
    """Bytes of an anchor: short ones are shared by chance the more, the larger the corpus is."""
    return GRAM if length >= 2 * GRAM else GRAM // 2


def gram_hashes(data: bytes, gram: int = GRAM) -> np.ndarray:
    """A hash of the ``gram`` bytes, 32 or 64, from every position."""
    words, n = words_at(data), len(data) - 32 + 1
    total = np.zeros(n, np.uint64)
    for j in range(0, 32, 8):
        part = words[j : j + n] * _M[j // 8]
        part ^= part >> np.uint64(29)
        total *= _M[3]
        total += part
    if gram > 32:
        total = total[:-32] * _M[1] + total[32:]
    total ^= total >> np.uint64(32)
    total *= _M[0]
    total ^= total >> np.uint64(29)
    return total


def sliding(least, values: np.ndarray, width: int) -> np.ndarray:
    """least (minimum or maximum) over every run of ``width`` values, by doubling."""
    size = 1
    while 2 * size <= width:
        values = least(values[:-size], values[size:])
        size *= 2
    return least(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def thinned(pos: np.ndarray, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors that are kept, and how many each stands for.

    A run of ``width`` positions that holds an anchor holds one that is kept with
    the same hash: after one that is kept the last within ``width`` is next.
    """
    by = np.argsort(hashes, kind="stable")
    new = np.append(True, np.diff(hashes[by].view(np.int64)) != 0)
    place = (np.cumsum(new) << 40) + pos[by]
    after = np.maximum(np.searchsorted(place, place + width, "right") - 1, np.arange(1, len(by) + 1))
    if (np.diff(after) == 1).all():
        return pos, hashes, np.ones(len(pos), np.int64)
    steps, kept, i = after.tolist(), [], 0
    while i < len(steps):
        kept.append(i)
        i = steps[i]
    counts = np.diff(np.append(kept, len(by)))
    own = by[kept]
    order = np.argsort(own)
    return pos[own[order]], hashes[own[order]], counts[order]


def anchors(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of a text, taken a piece at a time, and how many each stands for."""
    gram = gram_of(length)
    width, found = length - gram + 1, []
    for at in range(0, max(1, len(data) - length + 1), PIECE):
        low, high = max(0, at - length), min(len(data), at + PIECE + 2 * length)
        if high - low < length:
            break
        hashes = gram_hashes(data[low:high], gram)
        least = sliding(np.minimum, hashes, width)
        edge = np.zeros(width - 1, np.uint64)
        own = sliding(np.maximum, np.concatenate((edge, least, edge)), width)
        here = np.flatnonzero(own == hashes)
        last = at + PIECE >= len(data) - length + 1
        here = here[(here + low >= at) & (last | (here + low < at + PIECE))]
        found.append((here + low, hashes[here]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return thinned(*(np.concatenate(x) for x in zip(*found)), width)


# -- suffix array of a shard -----------------------------------------------------------------


def suffix_array(data: bytes, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions sorted by their first ``depth`` bytes at least, their ranks (equal
    where these bytes are), and the words used.

    Larsson and Sadakane's refinement: positions are first sorted by eight
    bytes; then only positions in a group of several are sorted again, by the
    rank of the position ``h`` further on, with ``h`` doubled each time.
    """
    n, words = len(data), words_at(data)
    order = np.argsort(words)
    new = np.empty(n, bool)
    new[:1] = True
    ordered = words[order]
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.zeros(n + 2 * depth, np.int64)
    rank[n:] = -1
    rank[order] = first
    h = 8
    while h < depth:
        alone = new.copy()
        alone[:-1] &= new[1:]
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        own = order[slots]
        key = (rank[own].astype(np.uint64) << np.uint64(32)) | (rank[own + h] + 1).astype(np.uint64)
        by = np.argsort(key)
        order[slots] = own[by]
        key = key[by]
        split = np.empty(len(key), bool)
        split[0] = True
        np.not_equal(key[1:], key[:-1], out=split[1:])
        new[slots] = split
        # a group keeps its slots; the rank of a member is the first slot of its new group
        rank[order[slots]] = np.maximum.accumulate(np.where(split, slots, 0))
        h *= 2
    # equals stand in order of the text, so that walks along copies keep step
    alone = new.copy()
    alone[:-1] &= new[1:]
    slots = np.flatnonzero(~alone)
    own = order[slots]
    order[slots] = own[np.argsort((rank[own] << 32) | own)]
    return order, rank[:n], words


def common_prefixes(
    order: np.ndarray, rank: np.ndarray, words: np.ndarray, most: int, lane: int = 512
) -> np.ndarray:
    """Bytes each position shares with its predecessor in ``order``, up to ``most``.

    Kasai's walk: from one position to the next the common prefix shrinks by one
    byte at most. Where a position and its predecessor have one rank their order
    is open, so that holds only if the next predecessor is the next position, and
    the walk starts anew otherwise. The text is walked in lanes side by side.
    """
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    tied = rank[before] == rank
    tied[order[:1]] = False
    anew = np.zeros(n, bool)
    anew[1:] = tied[:-1] & (before[1:] != before[:-1] + 1)
    shared = np.zeros(n, np.int32)
    padded = np.concatenate((words, np.zeros(most + 8, np.uint64)))
    lanes = np.arange(0, n, lane)
    depth = np.zeros(len(lanes), np.int64)
    steps = [np.uint64(1) << np.uint64(8 * k) for k in range(1, 8)]
    for t in range(lane):
        if t and lanes[-1] + t >= n:
            lanes, depth = lanes[:-1], depth[:-1]
            if not len(lanes):
                break
        at = lanes + t
        other = before[at]
        depth = np.where((other < 0) | anew[at], 0, np.maximum(depth - 1, 0))
        open_ = np.flatnonzero((other >= 0) & (depth < most))
        while len(open_):
            apart = padded[at[open_] + depth[open_]] ^ padded[other[open_] + depth[open_]]
            same = apart == 0
            ended = open_[~same]
            if len(ended):
                left = apart[~same]
                more = np.full(len(left), 7)
                for s in steps:
                    more -= left >= s
                depth[ended] += more
            open_ = open_[same]
            depth[open_] += 8
            open_ = open_[depth[open_] < most]
        depth = np.minimum(depth, most)
        shared[at] = depth
    return shared


def shard_classes(data: bytes, valid: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For every position: does its string also start at another valid position
    of the shard; does it stand for its class."""
    order, rank, words = suffix_array(data, length)
    shared = common_prefixes(order, rank, words, length)
    new = shared[order] < length
    new[:1] = True
    group = np.cumsum(new) - 1
    ok = valid[order]
    n_valid = np.bincount(group, weights=ok, minlength=len(order)).astype(np.int64)
    twice = np.zeros(len(data), bool)
    twice[order] = ok & (n_valid[group] > 1)
    stands = np.zeros(len(data), bool)
    picked = np.flatnonzero(ok)
    _, lead = np.unique(group[picked], return_index=True)
    stands[order[picked[lead]]] = True
    return twice, stands


# -- fingerprints of strings -------------------------------------------------------------------

_RNG = np.random.default_rng(400)
_BYTES = _RNG.integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASE = (0x2545F4914F6CDD1D, 0x5851F42D4C957F2D)
_BLOCK = 1 << 16
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1) modulo 2**64; kept, since blocks of one size need the same."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        steps = np.full(n, np.uint64(base))
        steps[0] = 1
        known = _POWERS[base] = np.cumprod(steps)
    return known[:n]


def string_prints(data: bytes, starts: np.ndarray, length: int) -> np.ndarray:
    """Two 64-bit numbers per start, in ascending order, that follow from its ``length`` bytes.

    A polynomial over a random number per byte value, modulo 2**64; strings of
    this length are far too short for the known clashes of that modulus. The bytes
    are taken a block at a time.
    """
    raw, found = np.frombuffer(data, np.uint8), np.empty((len(starts), 2), np.uint64)
    for at in range(0, len(raw), _BLOCK):
        own = slice(*np.searchsorted(starts, (at, at + _BLOCK)))
        first, part = starts[own] - at, raw[at : at + _BLOCK + length]
        if not len(first):
            continue
        for i, (table, base) in enumerate(zip(_BYTES, _BASE)):
            down = _powers(pow(base, -1, 2**64), len(part))
            sums = np.concatenate(([np.uint64(0)], np.cumsum(table[part] * _powers(base, len(part)))))
            found[own, i] = (sums[first + length] - sums[first]) * down[first]
    return found


def found_twice(prints: np.ndarray) -> np.ndarray:
    """For every string: does its fingerprint take up two places among the sorted ones?

    Strings are looked up in order of their first number, so that each binary
    search goes on where the last one ended; strings whose first numbers alone
    are equal are told apart by the second.
    """
    by = np.argsort(prints[:, 0])
    high, low = prints[by, 0], prints[by, 1]
    first, last = np.searchsorted(high, high, "left"), np.searchsorted(high, high, "right")
    again = last - first > 1
    mixed = np.unique(high[again & (low != low[first])])
    for place in np.flatnonzero(np.isin(high, mixed)) if len(mixed) else ():
        again[place] = (low[first[place] : last[place]] == low[place]).sum() > 1
    found = np.empty(len(again), bool)
    found[by] = again
    return found


def runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of every run of consecutive numbers in sorted ``places``."""
    if not len(places):
        return places, places
    cut = np.flatnonzero(np.diff(places) > 1)
    return places[np.append(0, cut + 1)], places[np.append(cut, len(places) - 1)]


# -- Spark -------------------------------------------------------------------------------------


def text_key(text: Column) -> Column:
    """Sixteen bytes that stand for the text."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def _anchor_rows(documents: DataFrame, length: int) -> DataFrame:
    """(hash, key, pos, stands) of every anchor of the texts; a task takes a text it meets again once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for text in batch.column(0).cast(pa.large_binary()):
                data = text.as_py()
                key = hashlib.sha256(data).digest()[:16]
                if key in seen:
                    continue
                seen.add(key)
                pos, hashes, stands = anchors(data, length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array([key] * len(pos), pa.binary()), pa.array(pos), pa.array(stands)],
                    names=["hash", "key", "pos", "stands"],
                )

    texts = documents.filter(F.octet_length("text") >= length).select("text")
    return texts.mapInArrow(merged(run), "hash long, key binary, pos long, stands long")


def merged(run, rows: int = 20_000):
    """``run`` with its small output batches put together."""

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in run(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= rows or len(held) >= 2000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return together


def _once(texts: DataFrame) -> DataFrame:
    """(key, text), a text once per task: copies shrink before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            fresh = [k not in seen and not seen.add(k) for k in keys]
            yield batch.filter(pa.array(fresh, pa.bool_()))

    return texts.mapInArrow(run, "key binary, text string")


def _regions(texts: DataFrame, length: int) -> DataFrame:
    """(sketch, key, at, bytes, pos, hash, n): candidate regions in pieces of bounded length.

    Each piece has the anchors (places within it, hashes, and how often they
    occur) and ``length - 1`` bytes beyond its last own start.
    """
    gram = gram_of(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(name) for name in ("key", "text", "anchors")]
            for key, text, marks in zip(*columns):
                data = text.as_py().encode()
                pos = marks.values.field("pos").to_numpy(zero_copy_only=False)
                hashes = marks.values.field("hash").to_numpy(zero_copy_only=False)
                often = marks.values.field("n").to_numpy(zero_copy_only=False)
                by = np.argsort(pos, kind="stable")
                by = by[np.append(True, np.diff(pos[by]) > 0)]
                pos, hashes, often = pos[by], hashes[by], often[by]
                starts = np.maximum(pos + gram - length, 0)
                last = np.minimum(pos, len(data) - length)
                cut = np.flatnonzero(starts[1:] > last[:-1] + 1)
                rows = []
                for i, j in zip(np.append(0, cut + 1), np.append(cut, len(pos) - 1)):
                    for at in range(int(starts[i]), int(last[j]) + 1, PIECE):
                        end = min(at + PIECE, int(last[j]) + 1)
                        inside = slice(*np.searchsorted(pos, [at, end + length - gram]))
                        rows.append((
                            int(hashes[inside].min()), key.as_py(), at, data[at : end + length - 1],
                            pos[inside] - at, hashes[inside], often[inside],
                        ))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (
                        pa.int64(), pa.binary(), pa.int64(), pa.binary(),
                        pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()),
                    ))],
                    names=["sketch", "key", "at", "bytes", "pos", "hash", "n"],
                )

    return texts.mapInArrow(
        merged(run, 500),
        "sketch long, key binary, at long, bytes binary, pos array<long>, hash array<long>, n array<long>",
    )


_FOUND = "kind int, hash long, print long, key binary, at long, last long, bytes binary"


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
    names = [part.split()[0] for part in _FOUND.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def _owned(pos: np.ndarray, hashes: np.ndarray, n: int, length: int) -> np.ndarray:
    """For each of ``n`` starts the index of its lowest anchor, the first of equals, or -1."""
    low = np.full(n + length, _TOP)
    low[pos] = hashes.view(np.uint64)
    least = sliding(np.minimum, low, length - gram_of(length) + 1)[:n]
    # of equal lowest hashes the first anchor at or after the start
    owner = np.full(n, -1, np.int64)
    open_ = np.flatnonzero(least != _TOP)
    after = np.searchsorted(pos, open_)
    while len(open_):
        hit = hashes[after].view(np.uint64) == least[open_]
        owner[open_[hit]] = after[hit]
        open_, after = open_[~hit], after[~hit] + 1
    return owner


def _shards(regions: DataFrame, length: int, hot: int) -> DataFrame:
    """What a shard finds: runs of repeated starts (kind 0), windows for the merge
    (kind 1) and single starts of hot anchors (kind 2)."""

    def shard(pieces: list[dict]) -> Iterator[pa.RecordBatch]:
        data = b"".join(p["bytes"] for p in pieces)
        valid, at = np.zeros(len(data), bool), 0
        for p in pieces:
            valid[at : at + len(p["bytes"]) - length + 1] = True
            at += len(p["bytes"])
        twice, stands = shard_classes(data, valid, length)
        at, rows = 0, []
        for p in pieces:
            n, text, key, base = len(p["bytes"]) - length + 1, p["bytes"], p["key"], p["at"]
            for s, e in zip(*runs(np.flatnonzero(twice[at : at + n]))):
                rows.append((0, 0, 0, key, base + int(s), base + int(e), None))
            owner = _owned(p["pos"], p["hash"], n, length)
            own = stands[at : at + n] & (owner >= 0)
            cut = np.flatnonzero(np.diff(owner)) + 1
            for s, e in zip(np.append(0, cut), np.append(cut, n)):
                if not own[s:e].any():
                    continue
                mark = owner[s]
                s, e = s + int(own[s:e].argmax()), e - int(own[s:e][::-1].argmax())
                if p["n"][mark] <= hot:
                    rows.append((1, int(p["hash"][mark]), 0, key, base + int(s), base + int(e) - 1, text[s : e + length - 1]))
                    continue
                places = np.flatnonzero(own[s:e])
                prints = string_prints(text[s : e + length - 1], places, length).view(np.int64)
                for place, (a, b) in zip((base + s + places).tolist(), prints.tolist()):
                    rows.append((2, a, b, key, place, place, None))
            at += len(text)
            if len(rows) > 2000:
                yield _table(rows)
                rows = []
        if rows:
            yield _table(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, size = [], 0
        for batch in batches:
            columns = batch.to_pydict()
            for key, at, text, pos, hashes, often in zip(*(columns[c] for c in ("key", "at", "bytes", "pos", "hash", "n"))):
                if pieces and size + len(text) > SHARD_BYTES:
                    yield from shard(pieces)
                    pieces, size = [], 0
                pieces.append({
                    "key": key, "at": at, "bytes": text, "n": often,
                    "pos": np.array(pos, np.int64), "hash": np.array(hashes, np.int64),
                })
                size += len(text)
        if pieces:
            yield from shard(pieces)

    near = regions.repartitionByRange("sketch", "key", "at").sortWithinPartitions("sketch", "key", "at")
    return near.mapInArrow(run, _FOUND)


def _merge(windows: DataFrame, length: int) -> DataFrame:
    """Runs of starts whose strings occur in several windows of their anchor."""

    def lookup(groups: list[tuple[int, bytes, int, bytes]]) -> Iterator[pa.RecordBatch]:
        data = b"".join(g[3] for g in groups)
        sizes = np.array([len(g[3]) for g in groups])
        offsets = np.cumsum(sizes) - sizes
        counts = sizes - length + 1
        of = np.repeat(np.arange(len(groups)), counts)
        inner = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        prints = string_prints(data, offsets[of] + inner, length)
        hits = np.flatnonzero(found_twice(prints))
        flat = hits + of[hits]  # a gap between windows
        starts, ends = runs(flat)
        rows = []
        for s, e in zip(np.searchsorted(flat, starts), np.searchsorted(flat, ends)):
            s, e = hits[s], hits[e]
            _, key, at, _ = groups[of[s]]
            rows.append((0, 0, 0, key, at + int(inner[s]), at + int(inner[e]), None))
        if rows:
            yield _table(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            columns = batch.to_pydict()
            for row in zip(*(columns[c] for c in ("hash", "key", "at", "bytes"))):
                if size > SHARD_BYTES // 2 and row[0] != held[-1][0]:
                    yield from lookup(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield from lookup(held)

    return (
        windows.select("hash", "key", "at", "bytes").repartition("hash").sortWithinPartitions("hash")
        .mapInArrow(merged(run), _FOUND)
    )


def repeated_starts(documents: DataFrame, length: int = LENGTH, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(key, spans) with the runs of repeated starts of a text, and (key, text)
    of the texts they lie in, each once."""
    if length < 2 * gram_of(length):
        raise ValueError("strings must be longer than two anchors")
    marks = stored(_anchor_rows(documents, length))
    often = stored(
        marks.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.sum("stands").alias("all"))
        .filter(F.col("all") > 1).drop("all")
    )
    # a text that several tasks have met has its anchors several times, all the same: one set and one text are kept
    wanted = (
        marks.drop("stands").join(often, "hash").groupBy("key")
        .agg(F.collect_set(F.struct("pos", "hash", "n")).alias("anchors"))
    )
    texts = documents.filter(F.octet_length("text") >= length).select(text_key(F.col("text")).alias("key"), "text")
    candidates = stored(
        _once(texts).join(wanted, "key").groupBy("key")
        .agg(F.any_value("text").alias("text"), F.any_value("anchors").alias("anchors"))
    )
    found = stored(_shards(stored(_regions(candidates, length)), length, hot))
    own = found.filter(F.col("kind") == 0)
    across = _merge(found.filter(F.col("kind") == 1), length)
    single = found.filter(F.col("kind") == 2)
    twice = single.groupBy("hash", "print").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    hot_found = single.join(twice, ["hash", "print"], "left_semi")
    spans = (
        own.select("key", "at", "last").union(across.select("key", "at", "last"))
        .union(hot_found.select("key", "at", "last"))
        .groupBy("key").agg(F.collect_list(F.struct("at", "last")).alias("spans"))
    )
    return spans, candidates.select("key", "text")


def covered(spans, size: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed runs [start, end) of a text from its runs of repeated starts."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, spans[:, 0], 1)
    np.add.at(edge, np.minimum(spans[:, 1] + length, size), -1)
    gone = np.cumsum(edge[:-1]) > 0
    starts, ends = runs(np.flatnonzero(gone))
    return starts, ends + 1


def whole_characters(data: bytes, start: int, end: int) -> tuple[int, int]:
    """The run cut down to characters that lie wholly inside it."""
    inside = lambda i: i < len(data) and data[i] & 0xC0 == 0x80
    while start < end and inside(start):
        start += 1
    while start < end and inside(end):
        end -= 1
    return start, end


def _pairs(value) -> np.ndarray:
    return np.stack([value.values.field(c).to_numpy(zero_copy_only=False) for c in ("at", "last")], axis=1)


def removed(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, cuts, pieces, n_removed, n_spans, kept_sha256) of every text that loses bytes.

    ``cuts`` are the maximal removed runs of bytes. ``pieces`` is what is left
    when a character that is covered in part only stays.
    """
    spans, texts = repeated_starts(documents, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, found in zip(*(batch.column(c) for c in ("key", "text", "spans"))):
                data = text.as_py().encode()
                starts, ends = covered(_pairs(found), len(data), length)
                rest = np.append(0, ends), np.append(starts, len(data))
                kept = hashlib.sha256()
                for s, e in zip(*rest):
                    kept.update(data[s:e])
                cuts = [{"start": int(s), "end": int(e)} for s, e in zip(starts, ends)]
                edges = [0, *(x for c in cuts for x in whole_characters(data, c["start"], c["end"])), len(data)]
                pieces = [{"start": s, "end": e} for s, e in zip(edges[::2], edges[1::2]) if s < e]
                rows.append((key.as_py(), cuts, pieces, int((ends - starts).sum()), len(starts), kept.hexdigest()))
            if rows:
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                kinds = (pa.binary(), span, span, pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                    names=["key", "cuts", "pieces", "n_removed", "n_spans", "kept_sha256"],
                )

    return (
        texts.join(spans, "key").select("key", "text", "spans")
        .mapInArrow(
            run,
            "key binary, cuts array<struct<start:long,end:long>>, pieces array<struct<start:long,end:long>>, "
            "n_removed long, n_spans long, kept_sha256 string",
        )
        .dropDuplicates(["key"])
    )


def _losses(documents: DataFrame, length: int) -> DataFrame:
    """``removed`` by key, with the texts that have copies, which lose all bytes,
    whether or not a task has met two of them."""
    return settled(documents.sparkSession, lambda: _all_losses(documents, length))


def _all_losses(documents: DataFrame, length: int) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    copies = (
        documents.filter(F.octet_length("text") >= length)
        .groupBy(text_key(F.col("text")).alias("key"))
        .agg(F.count(F.lit(1)).alias("copies"), F.max(F.octet_length(text)).cast("long").alias("size"))
        .filter(F.col("copies") > 1)
    )
    span = "array<struct<start:long,end:long>>"
    whole = copies.select(
        "key", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("size").alias("end"))).alias("cuts"),
        F.array().cast(span).alias("pieces"), F.col("size").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
        F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"),
    )
    return removed(documents, length).join(copies, "key", "left_anti").unionByName(whole)


def span_table(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and cuts of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        "doc_id", text_key(F.col("text")).alias("key"), F.octet_length(text).cast("long").alias("n_bytes"),
        F.sha2(text.cast("binary"), 256).alias("whole"),
    )
    none = F.array().cast("array<struct<start:long,end:long>>")
    return rows.join(_losses(documents, length), "key", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"), F.coalesce("cuts", none).alias("cuts"),
    )


def cut_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """``documents`` without the repeated strings, all rows and columns kept.

    A character that is covered in part stays; a text that is covered as a whole
    becomes empty; ``n_chars``, where there is one, follows the text.
    """
    rows = documents.select(F.struct("*").alias("row"), text_key(F.col("text")).alias("key"))
    joined = rows.join(_losses(documents, length).select("key", "pieces"), "key", "left")
    data = F.col("row.text").cast("binary")
    left = F.array_join(
        F.transform(
            "pieces",
            lambda p: F.substring(data, (p["start"] + 1).cast("int"), (p["end"] - p["start"]).cast("int")).cast("string"),
        ),
        "",
    )
    cut = F.when(F.col("pieces").isNull(), F.col("row.text")).otherwise(left)
    text = joined.select("row", cut.alias("text"))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        row = row.withField("n_chars", F.when(F.col("text").isNull(), F.col("row.n_chars")).otherwise(
            F.char_length("text").cast(kind)))
    return text.select(row.alias("row")).select("row.*")
