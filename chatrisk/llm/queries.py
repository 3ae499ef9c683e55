"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatrisk.llm import (
    alignment, chat, context_mixing, decontaminate, fingerprints, hard_negatives, licenses, mixing, near_duplicates, pii,
    quality, token_counts, toxicity,
)
from chatrisk.llm import oracle as o
from chatrisk.llm.batches import tuned
from chatrisk.plans.checkpoints import checkpointed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = lambda spark, sf_dir: function(tuned(spark), sf_dir)
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.scored(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checkpointed(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "personal-data")
    return pii.with_digest(pii.selected(found, pii.train(found)))


@query(o.DECONTAMINATION)
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return decontaminate.with_digest(found).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


@query()
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    def is_held(doc_id: Column) -> Column:
        return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0

    found = toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), is_held)
    return found.select("doc_id", "held_out", "score", "predicted")


@query()
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents"))


@query(o.QUALITY)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query()
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates.near_duplicates(docs, shingle=3, percent=85).select(
        "doc_id", "n_shingles", "component_id", "kept"
    )


@query(o.MIXING)
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.text_words().alias("words"))
    # A document of 50 words or more counts for two shorter ones.
    band = F.when(F.col("words") >= 50, 2.0).otherwise(1.0)
    return mixing.mixed(checkpointed(docs, "mix-words"), size=F.col("words"), weight=band).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


@query()
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return licenses.with_digest(found).drop("text")


@query(o.CHAT)
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = f"{chat.END}{chat.START}assistant ok"
    extra = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"),
    )
    return chat.with_digest(chat.formatted(rows.unionByName(extra)))


@query()
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"))


@query(o.HARD_NEGATIVES)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = hard_negatives.prepared(table(spark, sf_dir, "embeddings"), F.col("vec_id"), moved, F.col("embedding"))
    return hard_negatives.mined(rows, F.col("vec_id") % 100 == 0)


@query()
def op13_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.near_fingerprints(table(spark, sf_dir, "documents"))
