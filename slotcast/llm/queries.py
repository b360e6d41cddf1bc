"""Registered queries of the operators in this folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotcast.llm import (
    chat, clusters, decontaminate, infill, language, mixing, quality, rules, simhash, sql, substrings, toxicity, urls,
    warc,
)
from slotcast.llm.store import fold, settled


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_table(table(spark, sf, "documents"))


def op4_language(spark: SparkSession, sf: str) -> DataFrame:
    documents, held_out = table(spark, sf, "documents"), fold(F.col("doc_id"), 4) == 2
    net = language.fit(documents.filter(~held_out))
    return language.detect(documents, net).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


def op5_quality(spark: SparkSession, sf: str) -> DataFrame:
    def make() -> DataFrame:
        known, held_out = quality.statistics(table(spark, sf, "documents")), fold(F.col("doc_id"), 5) == 0
        score = quality.fit(known.filter(~held_out), table(spark, sf, "labels")).expression()
        return known.select(
            "doc_id", held_out.alias("held_out"), score.alias("score"),
            (score >= quality.THRESHOLD).cast("int").alias("predicted"),
        )

    return settled(spark, make)


def op6_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.hits(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op7_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    given = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], given.schema)
    return chat.digests(chat.format_chats(given.union(extra)))


def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    documents, held_out = table(spark, sf, "documents"), fold(F.col("doc_id"), 3) == 1
    model = toxicity.fit(documents.filter(~held_out), table(spark, sf, "labels"))
    return toxicity.score(documents, model).select(
        "doc_id", held_out.alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op9_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.span_table(table(spark, sf, "documents")).drop("cuts")


def op10_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return rules.judge(table(spark, sf, "documents"))


# The rules of the url query.
URL_RULES = (
    ("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"),
)


def op2_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    rules_ = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return urls.judge(table(spark, sf, "pages"), rules_)


def op3_simhash_near_copies(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf, "documents")).select(
        "doc_id", "fingerprint", "component_id"
    )


def op11_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.round_trip(table(spark, sf, "pages"))


def op12_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.cluster_table(table(spark, sf, "embeddings"))


def op13_infill(spark: SparkSession, sf: str) -> DataFrame:
    return infill.digests(infill.cut(table(spark, sf, "documents")))


QUERIES = {
    f.__name__: f for f in (
        op1_mix_sources, op2_url_filter, op3_simhash_near_copies, op4_language, op5_quality,
        op6_decontamination, op7_chat_format, op8_toxicity, op9_suffix_array_dedup,
        op10_quality_rules, op11_warc, op12_centroids, op13_infill,
    )
}
ORACLES = sql.ORACLES
