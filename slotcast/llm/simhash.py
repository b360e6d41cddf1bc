r"""Near copies by 64-bit SimHash, with pigeonring filtering of the candidates.

A fingerprint is cut into ``SEGMENTS`` pieces in a ring. If two fingerprints
differ in at most ``DISTANCE`` bits, some piece starts a chain in which the
first l pieces together differ in at most l * DISTANCE / SEGMENTS bits, for
every l. With four pieces and three bits the budgets are 0, 1, 2 and 3. So the
first piece of the chain is equal and the second differs in one bit at most,
whence one of its two halves is equal too: piece and half are the join key.
Within a key the chain is followed piece by piece, and what is left is checked
in full.

A key with more fingerprints than ``BLOCK`` is dealt out as pairs of blocks, so
that no task meets it whole and every pair still meets once. A task returns a
forest of its links, never all pairs. Distinct fingerprints meet once, however
many documents have them.

Defined results: a null or empty text has fingerprint zero, which links like any
other; fewer words than a shingle make one shingle; the representative of a
component is its smallest doc_id, null if it has none; repeated rows share a
component; an empty table gives an empty result; texts of any length are hashed
whole, some shingles at a time; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from slotcast.llm.components import components
from slotcast.llm.store import settled, stored

DISTANCE = 3
SEGMENTS = 4
SHINGLE = 3
SEED = 42
BLOCK = 4096
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_hashes(text: bytes, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """Hashes of all word shingles of a text, some at a time."""
    words = text.translate(_LOWER).split()
    if not words:
        return
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < width:
        yield np.array([digest(joined, SEED)], np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    for at in range(0, len(starts), 65536):
        spans = zip(starts[at : at + 65536], ends[at : at + 65536])
        yield np.fromiter((digest(joined[s:e], SEED) for s, e in spans), np.uint64)


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingle hashes, as a signed number."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, width):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(documents: DataFrame, *keep: str) -> DataFrame:
    """The ``keep`` columns of every row and its fingerprint as a long."""
    schema = StructType(
        [*(documents.schema[k] for k in keep), StructField("fingerprint", LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.large_binary())
            found = [fingerprint(t.as_py() or b"") for t in texts]
            columns = [*batch.columns[: len(keep)], pa.array(found, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "fingerprint"])

    return documents.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def _keys(fingerprint: Column, segments: int, distance: int) -> Column:
    """Array of (key, ring): the fingerprint turned so that the chain starts at its lowest bits."""
    bits = 64 // segments
    pieces = 2 * distance // segments + 1
    width = bits // pieces
    found = []
    for i in range(segments):
        turned = fingerprint if i == 0 else F.shiftrightunsigned(fingerprint, bits * i).bitwiseOR(
            F.shiftleft(fingerprint, 64 - bits * i)
        )
        first = turned.bitwiseAND(F.lit((1 << bits) - 1))
        for p in range(pieces):
            size = width if p + 1 < pieces else bits - width * p
            part = F.shiftrightunsigned(turned, bits + width * p).bitwiseAND(F.lit((1 << size) - 1))
            key = F.shiftleft(first, 24).bitwiseOR(F.shiftleft(part, 8)).bitwiseOR(F.lit(i * pieces + p))
            found.append(F.struct(key.alias("key"), turned.alias("ring"), fingerprint.alias("fingerprint")))
    return F.array(*found)


def _linked(left: np.ndarray, right: np.ndarray, segments: int, distance: int) -> np.ndarray:
    """Places where the chain stays within its budgets and the whole within ``distance``."""
    bits, at = 64 // segments, np.arange(len(left))
    apart = left ^ right
    for chain in range(1, segments + 1):
        mask = np.uint64(2 ** (bits * chain) - 1)
        ok = np.bitwise_count(apart & mask) <= chain * distance // segments
        at, apart = at[ok], apart[ok]
    return at


def _forest(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index each of ``size`` vertices is tied to.

    Roots are hooked, never members: all that have a root move with it, so an
    edge within one root can be dropped and no link is lost.
    """
    label = np.arange(size)
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


def _group_links(starts: np.ndarray, rings: np.ndarray, segments: int, distance: int) -> np.ndarray:
    """The label of every row; ``starts`` holds the first row of each key."""
    n = len(rings)
    ends = np.append(starts[1:], n)
    sizes = ends - starts
    group_end = np.repeat(ends, sizes)
    label = np.arange(n)
    small = np.repeat(sizes <= 64, sizes)
    rows = np.flatnonzero(small)
    a_all, b_all, step = [], [], 1
    while len(rows := rows[rows + step < group_end[rows]]):
        ok = _linked(rings[rows], rings[rows + step], segments, distance)
        a_all.append(rows[ok])
        b_all.append(rows[ok] + step)
        step += 1
    if a_all:
        label = _forest(n, np.concatenate(a_all), np.concatenate(b_all))
    for s, e in zip(starts[sizes > 64], ends[sizes > 64]):
        own, part = rings[s:e], np.arange(e - s)
        for at in range(0, e - s, 256):
            rows = np.arange(at, min(at + 256, e - s))
            left, right = np.repeat(rows, e - s - at), np.tile(np.arange(at, e - s), len(rows))
            ok = _linked(own[left], own[right], segments, distance)
            root = part.copy()
            tied = _forest(e - s, np.concatenate([left[ok], np.arange(e - s)]), np.concatenate([right[ok], root]))
            part = tied
        label[s:e] = s + part
    return label


def links(distinct: DataFrame, segments: int = SEGMENTS, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that tie all within ``distance`` together."""
    if not 0 <= distance < segments:
        raise ValueError("the first piece of a chain must be equal: fewer bits than pieces")
    keyed = distinct.select(F.inline(_keys(F.col("fingerprint"), segments, distance)))
    hot = (
        keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
        .select("key", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    )
    part = F.pmod(F.xxhash64("fingerprint", "key"), F.col("parts").cast("long")).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda q: F.struct(F.least("part", q).alias("p"), F.greatest("part", q).alias("q")),
    )
    dealt = (
        keyed.join(hot, "key", "left")
        .withColumn("part", part)
        .withColumn("to", F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q")))).otherwise(others))
        .select("key", F.explode("to").alias("to"), "ring")
        .select("key", "to.p", "to.q", "ring")
    )
    piece = 2 * distance // segments + 1
    bits = 64 // segments

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(group: np.ndarray, rings: np.ndarray, chain: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.append(True, (group[1:] != group[:-1]).any(axis=1)))
            label = _group_links(starts, rings, segments, distance)
            tied = np.flatnonzero(label != np.arange(len(label)))
            shift = (chain[tied] // piece * bits).astype(np.uint64)
            back = [  # turned back: a rotation to the left by what the key has turned it to the right
                np.where(shift == 0, v, (v << shift) | (v >> (np.uint64(64) - np.maximum(shift, np.uint64(1)))))
                for v in (rings[tied], rings[label[tied]])
            ]
            return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)) for v in back], names=["a", "b"])

        held: list[tuple] = []
        for batch in batches:
            group = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            rings = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            held.append((group, rings))
            group, rings = (np.concatenate(x) for x in zip(*held))
            last = int((group == group[-1]).all(axis=1).argmax()) if len(group) else 0
            if last:
                yield edges(group[:last], rings[:last], group[:last, 0] & 255)
            held = [(group[last:], rings[last:])]
        if held and len(held[0][0]):
            group, rings = held[0]
            yield edges(group, rings, group[:, 0] & 255)

    return (
        dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
        .mapInArrow(run, "a long, b long")
    )


def near_copies(documents: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, key (hash of the text), fingerprint (hex) and component_id of every row.

    ``first`` is true for one (doc_id, key) of each component.
    """
    return settled(documents.sparkSession, lambda: _near_copies(documents, distance))


def _near_copies(documents: DataFrame, distance: int) -> DataFrame:
    keyed = documents.select("doc_id", "text", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("key"))
    rows = stored(fingerprints(keyed, "doc_id", "key"))
    lowest = rows.groupBy("fingerprint").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("low")
    )
    lowest = stored(lowest)
    tied = components(links(lowest.select("fingerprint"), SEGMENTS, distance))
    joined = lowest.join(tied, lowest["fingerprint"] == tied["member"], "left").select(
        "fingerprint", "low", F.coalesce("component", "fingerprint").alias("component")
    )
    least = joined.groupBy("component").agg(F.min("low").alias("low"))
    of = joined.select("fingerprint", "component").join(least, "component").select("fingerprint", "low")
    low = F.col("low")
    return rows.join(of, "fingerprint").select(
        "doc_id", "key", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        low["doc_id"].alias("component_id"),
        (F.col("doc_id").eqNullSafe(low["doc_id"]) & (F.col("key") == low["key"])).alias("first"),
    )


def drop_near_copies(documents: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``documents`` with one row of each component: the smallest doc_id, null
    last, and of rows with that id the least text hash; of equal rows one."""
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    keep = (
        near_copies(documents, distance).filter("first")
        .select(name(F.col("doc_id")).alias("id"), "key").distinct()
    )
    rows = documents.select(
        F.struct("*").alias("row"), name(F.col("doc_id")).alias("id"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("key"),
    )
    return rows.join(keep, ["id", "key"], "left_semi").dropDuplicates(["id", "key"]).select("row.*")
