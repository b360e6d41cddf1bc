"""Cutting lineage in the folder that all machines share, and small column helpers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset: one in the
    warehouse, if all machines see it, as in local mode or on a store of its own.
    A cluster with a warehouse of local files has no shared folder, which is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        warehouse, master = spark.conf.get("spark.sql.warehouse.dir").rstrip("/"), spark.sparkContext.master
        if not re.match(r"local(\[|$)", master) and re.match(r"file:|/", warehouse):
            raise ValueError(
                "set spark.checkpoint.dir to a folder that the driver and all executors share: "
                f"it is unset, and the warehouse {warehouse} is a folder of one machine"
            )
        folder = f"{warehouse}/_llm"
    return folder.rstrip("/")


_OPEN: ContextVar[list[str] | None] = ContextVar("open", default=None)


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df`` written once and read again: lost executors cost a
    read, not the work before it, and branches share the one result.

    The table lives until the ``settled`` or ``owned`` call around it ends.
    """
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if (paths := _OPEN.get()) is not None:
        paths.append(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(table: DataFrame) -> None:
    """Removes a table of ``stored`` that nothing reads any more, before its owner would."""
    _remove(table.sparkSession, table.stored_at)


@contextmanager
def owned(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are removed at the end, results of ``settled`` too: take what you need before."""
    paths: list[str] = []
    token = _OPEN.set(paths)
    try:
        yield
    finally:
        _OPEN.reset(token)
        for path in paths:
            _remove(spark, path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The stored result of ``make``; tables that were stored on the way are removed."""
    outer = _OPEN.get()
    with owned(spark):
        result = make()
        token = _OPEN.set(outer)
        try:
            return stored(result)
        finally:
            _OPEN.reset(token)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def settled_labels(labels: DataFrame, column: str) -> DataFrame:
    """One row (doc_id, label) per labelled document; nulls and contradictory rows are left out."""
    return (
        labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
        .groupBy("doc_id")
        .agg(F.min(column).alias("label"), F.max(column).alias("most"))
        .filter(F.col("label") == F.col("most"))
        .select("doc_id", F.col("label").cast("int").alias("label"))
    )


# Parts that the documents of a label are dealt over where the first of them are chosen.
PARTS = 8


def training_rows(
    documents: DataFrame, labelled: DataFrame, most: Column, limit: int, parts: int = PARTS
) -> DataFrame:
    """(label, text) of the first ``most`` documents of each label in hash order of
    their ids; ``limit`` is the largest ``most``.

    ``labelled`` has one (doc_id, label) per document. Only ids are ranked, first
    within parts of a label's ids by another hash, of which a task passes on no more
    than ``limit``, then among the first of each part, at most ``parts`` times
    ``limit`` ids of a label, whatever its share of the table. Those chosen are at
    most ``limit`` per label, so they are small enough to broadcast.
    """
    known = documents.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct().join(labelled, "doc_id")
    order = [F.xxhash64("doc_id"), "doc_id"]
    part = F.pmod(F.hash(F.lit("part"), "doc_id"), F.lit(parts)).alias("part")
    dealt = known.select("doc_id", "label", part)
    inner = F.row_number().over(Window.partitionBy("label", "part").orderBy(*order))
    first = dealt.withColumn("place", inner).filter(F.col("place") <= limit).drop("part", "place")
    outer = F.row_number().over(Window.partitionBy("label").orderBy(*order))
    ids = first.withColumn("place", outer).filter(F.col("place") <= most).select("doc_id", "label")
    return (
        documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
        .groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text")
    )
