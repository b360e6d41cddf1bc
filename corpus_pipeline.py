"""The corpus pipeline: from documents to a mixed, clean training set.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``documents``; the last returns a row for each time a
document is taken. Null and repeated rows, empty texts and empty tables are
treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotcast.llm import decontaminate, mixing, quality, simhash, substrings
from slotcast.llm.store import fold, settled, stored


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject; every fifth is held out of the fitting."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    known = quality.statistics(docs.select("doc_id", "text"))
    return quality.keep_good(docs, quality.fit(known.filter(fold(F.col("doc_id"), 5) != 0), labels))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: fingerprints of three-word shingles, at most three bits apart."""
    return simhash.drop_near_copies(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the byte strings that the corpus repeats."""
    return substrings.cut_repeats(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the source weights have them taken."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", without_near_copies),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", without_benchmark),
    ("mixing to target weights", mixed),
]

# Forest, near copies and byte strings are beyond SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of ``sf_dir``."""

    def chain() -> DataFrame:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for _, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir))
        return docs

    return settled(spark, chain)
