"""Mixing sources to target weights by systematic sampling.

Sources in code point order, null last, get the weights of a repeating cycle
and share ``volume`` times all words by weight. A source is repeated ``most``
times at best; what it cannot take is shared again among the others by weight.

Within a source each document is expected ``target / source_size`` times. The
documents stand in order of size, the expected copies are summed along that
order, a random offset of the source is added, and a document is taken once for
each whole number the sum passes. In order of size, what is taken differs from
the target by less than the largest document of the source. So that it differs
less, the offset is chosen among ``OFFSETS`` ones, spread evenly from the random
one on: all are worked out in one aggregate, and the one whose words come nearest
to the target is used.

Defined results: a null or empty text has size 0 and is taken like any other; a
null source is a source; null and repeated ids are ranked as rows of their own,
equal rows in any order; an empty table gives an empty result. Columns of any
name may stand beside those that are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotcast.llm.store import settled, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
VOLUME = 1.5
MOST = 2
OFFSETS = 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, volume: float = VOLUME, most: int = MOST
) -> DataFrame:
    """(source, source_size, target) from (source, size).

    One row per source is left before anything meets: the rank needs them in
    one order. The level of the shares is settled by one sum per round.
    """
    cycle = F.array(*map(F.lit, weights))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = stored(
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(cycle, (place % len(weights) + 1).cast("int")))
    )
    cap = F.lit(most) * F.col("source_size")
    level, full = None, F.lit(False)
    while True:
        row = sources.agg(
            F.sum("source_size").alias("all"),
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weights"),
        ).first()
        if not row["weights"]:
            break
        now = (volume * row["all"] - row["capped"]) / row["weights"]
        if now == level:
            break
        level, full = now, cap <= F.col("weight") * F.lit(now)
    share = cap if level is None else F.least(cap, F.col("weight") * F.lit(level))
    return sources.select("source", "source_size", share.cast("double").alias("target"))


def offset(source: Column, seed: str) -> Column:
    """A number in [0, 1) that follows from the source and the seed alone."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32


def with_copies(
    rows: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS,
    volume: float = VOLUME, most: int = MOST,
) -> DataFrame:
    """``rows`` (with source, size, doc_id) plus source_size, target and copies.

    A distributed sort numbers the rows of each range; the counts of source and
    range, which are few, turn that into the rank within the source. So a source
    with a third of all rows is spread over as many ranges as its rows need.
    """
    serial = F.monotonically_increasing_id()
    ranged = stored(
        rows.orderBy(F.col("source").asc_nulls_last(), F.desc("size"), F.col("doc_id").asc_nulls_last())
        .withColumn("serial", serial)
        .withColumn("range", F.shiftright("serial", 33))
    )
    blocks = ranged.groupBy("source", "range").agg(
        F.count(F.lit(1)).alias("n"), F.min("serial").alias("first"), F.sum("size").alias("size")
    )
    blocks = stored(blocks)
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    targets = source_targets(blocks, weights, volume, most).withColumnRenamed("source", "of")
    blocks = (
        blocks.withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(targets, F.col("source").eqNullSafe(F.col("of")))
        .select(F.col("source").alias("of"), F.col("range").alias("at"), "first", "skip", "source_size", "target")
    )
    rank = F.col("serial") - F.col("first") + F.col("skip") + 1
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    at_block = F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("at"))

    def copies(u: Column) -> Column:
        reached = lambda n: F.floor(n.cast("double") * rate + u)
        return reached(rank) - reached(rank - 1)

    def turned(j: Column) -> Column:
        """The random offset, and so many steps on."""
        moved = offset(F.col("of"), seed) + j.cast("double") / OFFSETS
        return moved - F.floor(moved)

    sums = [F.sum(copies(turned(F.lit(j))) * F.col("size")) for j in range(OFFSETS)]
    apart = F.transform("sums", lambda t, j: F.struct(F.abs(t - F.col("goal")).alias("apart"), j.alias("j")))
    # sizes and places alone are summed; the offset chosen goes to the few rows of ``blocks``
    chosen = (
        ranged.select("source", "range", "serial", "size").join(blocks, at_block)
        .groupBy("of").agg(F.array(*sums).alias("sums"), F.first("target").alias("goal"))
        .select(F.col("of").alias("whose"), turned(F.array_min(apart)["j"]).alias("u"))
    )
    placed = stored(blocks.join(chosen, F.col("of").eqNullSafe(F.col("whose"))).drop("whose"))
    return (
        ranged.join(placed, at_block).withColumn("copies", copies(F.col("u")))
        .drop("serial", "range", "of", "at", "first", "skip", "u")
    )


def mix(documents: DataFrame, seed: str = "mix", **how) -> DataFrame:
    """The mix itself: a row of ``documents`` for each time it is taken.

    It reads tables that are stored on the way; they live until the ``settled`` or
    ``owned`` call around it ends.
    """
    rows = documents.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), F.struct("*").alias("row")
    )
    taken = with_copies(rows, seed, **how).filter(F.col("copies") > 0)
    again = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return taken.select("row", again).select("row.*")


def mix_table(documents: DataFrame, seed: str = "mix", **how) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every row."""
    rows = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return settled(documents.sparkSession, lambda: with_copies(rows, seed, **how).select(
        "doc_id", "size", "source_size", "target", taken, "copies"
    ))
