"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotcast.llm.store import settled, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a vertex is tied to the least vertex around it."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (
        both.filter(F.col("b") > F.col("a")).join(least, "a")
        .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex and its smaller neighbours are tied to the least of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(member, component) for every vertex of ``edges`` (a, b), the least vertex being the component.

    Rows with a null and loops are ignored; a vertex without other edges has no
    row. A round is two joins on distributed tables; the number of rounds grows
    with the logarithm of the size. Only counts reach the driver.
    """
    return settled(edges.sparkSession, lambda: _contract(edges))


def _contract(edges: DataFrame) -> DataFrame:
    a, b = F.least("a", "b"), F.greatest("a", "b")
    now = stored(
        edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(b.alias("a"), a.alias("b")).distinct()
    )
    seen = None
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if mark == seen:
            break
        seen = mark
        now = stored(_small_star(_large_star(now)))
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("member"), F.col("b").alias("component")).union(
        roots.select("b", F.col("b").alias("component"))
    )
