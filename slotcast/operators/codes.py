"""Whole-number codes of categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotcast.functions.checkpoints import checkpointed
from slotcast.operators.joins import lookup_join

# A sorted row's number: partition in the high bits, place in the low 33.
PLACE_BITS = 33


def code_table(df: DataFrame, column: str, code: str) -> DataFrame:
    """(column, code): place of each distinct value in sorted order, from 0.

    The values are sorted over all tasks and numbered within each; adding the
    sizes of the preceding partitions makes the numbers run through. Only the
    sizes, one per partition, meet in one task. The checkpoint fixes the sorted
    partitions, since two reads of a sort may cut its ranges differently.
    """
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    placed = checkpointed(
        values.sort(column).withColumn("_place", F.monotonically_increasing_id())
    ).select(
        column,
        F.shiftright("_place", PLACE_BITS).alias("_partition"),
        F.col("_place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("_place"),
    )
    before = Window.orderBy("_partition").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_partition").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select(
        "_partition", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    return placed.join(F.broadcast(offsets), "_partition").select(
        column, (F.col("_offset") + F.col("_place")).cast("int").alias(code)
    )


def with_codes(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add a code column for each category column; null gets -1.

    The combinations that occur are taken from the table once and kept, so the
    work behind ``df`` is not repeated for every column.
    """
    occurring = checkpointed(df.select(*columns).distinct())
    coded = df
    for column, code in columns.items():
        coded = lookup_join(coded, code_table(occurring, column, code), column)
        coded = coded.withColumn(code, F.coalesce(F.col(code), F.lit(-1)))
    return coded
