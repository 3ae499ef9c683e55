"""A training corpus from raw documents: five stages, each over all that the one before it kept.

quality rules, near duplicates, benchmark decontamination, personal data, mixing to target weights. Every stage is
written to the shared folder and read again, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatrisk.llm import decontaminate, mixing, near_duplicates, pii, quality
from chatrisk.llm.batches import kept_rows, tuned
from chatrisk.plans.checkpoints import checkpointed

#: Columns of the documents table; a stage passes these on, n_chars measured again where the text has changed.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the table of thresholds."""
    tuned(spark)
    return kept_rows(quality.judged(docs.select(*COLUMNS)), F.col("kept")).select(*COLUMNS)


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity of 0.8 and more."""
    tuned(spark)
    return near_duplicates.deduplicated(docs.select(*COLUMNS), shingle=5, percent=80)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that consist of them for the greater part go."""
    tuned(spark)
    found = decontaminate.find_contamination(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _measured(decontaminate.remove_spans(found))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    tuned(spark)
    found = pii.find(docs.select(*COLUMNS))
    model = pii.train(checkpointed(found.select("proposals"), "proposals"))
    return _measured(pii.redacted(pii.selected(found, model)))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, copy_no from 0, with size, source_size and target."""
    tuned(spark)
    mix = mixing.mixed(docs.select(*COLUMNS))
    return mixing.materialised(mix).select(*COLUMNS, "copy_no", "size", "source_size", "target")


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicate_groups),
    ("decontamination", benchmark_passages),
    ("personal_data", personal_data),
    ("source_mixing", source_mix),
]

#: Boosted trees and the similarity join have no SQL; of the stages, only near duplicates are compared with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the documents table on."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
