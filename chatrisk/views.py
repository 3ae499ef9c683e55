"""Chat tables derived from the `events` table, for queries, tests and benchmarks.

Each event becomes a message. The text is a phrase picked from a short list by the event id, so
rules, pairs, escalation, arcs and runs all occur and the expected hits are known by hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatrisk.plans.skew import with_position

SINGLE = [
    "i understand you better than your family",
    "age is just a number",
    "you are so beautiful",
    "send me a pic",
    "don't tell your parents",
    "what are you wearing",
    "when do you walk home",
    "how old are you",
    "you promised",
    "what school do you go to",
    "would you date someone older",
    "let's meet up",
]
DOUBLE = [
    "are you home alone? don't tell your mom",
    "how old are you? send me a pic",
    "what are you wearing? you promised",
    "age is just a number, you need me",
]
BENIGN = "did you finish the book"


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _pick(phrases: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in phrases]), (index + 1).cast("int"))


def _die() -> Column:
    return (F.col("event_id") * 7919) % 97


def conversation_rows(events: DataFrame) -> DataFrame:
    """Messages (conv_id, ts, event_id, author, text_raw) of invented conversations, not yet indexed."""
    conv, i = F.col("conv_id"), F.col("_i")
    text = (
        F.when(i == 96, F.lit("  "))
        .when(conv % 5 == 1, _pick(DOUBLE, i % 4))
        .when((conv % 5 == 2) & (i < 60), _pick(SINGLE, i % 12))
        .when(i < 12, _pick(SINGLE, F.least(i, F.lit(11))))
        .otherwise(F.lit(BENIGN))
    )
    return (
        events.withColumn("conv_id", F.col("user_id") * 6 + F.col("event_id") % 6)
        .withColumn("_i", _die())
        .select(
            "conv_id", "ts", "event_id",
            F.concat_ws(":", "conv_id", "event_type").alias("author"), text.alias("text_raw"),
        )
    )


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, conv_idx, author, text_raw."""
    rows = conversation_rows(read_table(spark, sf_dir, "events"))
    indexed = with_position(rows, ["conv_id"], ["ts", "event_id"], "conv_idx")
    return indexed.select("conv_id", F.col("conv_idx").cast("int").alias("conv_idx"), "author", "text_raw")


def flagged_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """author_id of the invented flagged authors, with duplicates."""
    rows = conversation_rows(read_table(spark, sf_dir, "events"))
    kind = F.element_at(F.split("author", ":"), 2)
    return rows.filter(~kind.isin("view", "click") & (F.col("conv_id") % 3 != 0)).select(F.col("author").alias("author_id"))


def flagged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, author_id) ground truth of the same, with duplicates."""
    authors = flagged_authors(spark, sf_dir)
    return authors.select(F.split("author_id", ":")[0].cast("bigint").alias("conv_id"), "author_id")


def contact_messages(events: DataFrame) -> DataFrame:
    """contact_id, ts, msg_id, sender, text, ml_prob: one contact per user."""
    return events.withColumn("_i", _die()).select(
        F.col("user_id").alias("contact_id"), "ts", F.col("event_id").alias("msg_id"),
        F.when(F.col("event_type").isin("view", "click"), "child").otherwise("external").alias("sender"),
        F.when(F.col("_i") < 12, _pick(SINGLE, F.least("_i", F.lit(11)))).otherwise(F.lit(BENIGN)).alias("text"),
        F.least(F.col("value") / 125.0, F.lit(1.0)).alias("ml_prob"),
    )
