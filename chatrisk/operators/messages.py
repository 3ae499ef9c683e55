"""Message tables: index, flags, roles, labels, rule annotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatrisk.functions import rules, text
from chatrisk.functions.catalog import DEFAULT, Catalog
from chatrisk.plans.joins import lookup_join
from chatrisk.plans.skew import PIECE_ROWS, with_position


def index_messages(df: DataFrame, keys: list[str], order: list[str], piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Add conv_idx, the position in the conversation before anything is dropped."""
    placed = with_position(df, keys, order, "conv_idx", piece_rows)
    return placed.withColumn("conv_idx", F.col("conv_idx").cast("int"))


def flag_by_author(messages: DataFrame, authors: DataFrame) -> DataFrame:
    """Add is_flagged: the author is in the flagged set, in whatever conversation."""
    listed = authors.select(F.col("author_id").alias("author")).distinct().withColumn("_listed", F.lit(True))
    return lookup_join(messages, listed, ["author"]).withColumn(
        "is_flagged", F.col("_listed").isNotNull()).drop("_listed")


def flag_by_truth(messages: DataFrame, truth: DataFrame) -> DataFrame:
    """Add is_flagged: (conversation, author) is in the ground truth."""
    listed = truth.select("conv_id", F.col("author_id").alias("author")).distinct().withColumn("_listed", F.lit(True))
    return lookup_join(messages, listed, ["conv_id", "author"]).withColumn(
        "is_flagged", F.col("_listed").isNotNull()).drop("_listed")


def conversation_labels(messages: DataFrame) -> DataFrame:
    """label 1 for conversations with a flagged message, blank ones included."""
    return messages.groupBy("conv_id").agg(F.max(F.col("is_flagged").cast("int")).alias("label"))


def flagged_conversations(messages: DataFrame) -> DataFrame:
    return messages.filter("is_flagged").select("conv_id").distinct()


def role_tag(flagged: str = "is_flagged") -> Column:
    return F.when(F.col(flagged), F.lit("[PRED]")).otherwise(F.lit("[USER]"))


def annotate_messages(
    messages: DataFrame, *, scope: str = "flagged", catalog: Catalog = DEFAULT, slang=None,
    normalised: bool = True, gate: bool = True,
) -> DataFrame:
    """Add norm, matches, max_severity, cat_mask, n_hits, critical.

    `scope` 'flagged' matches flagged authors only; 'all' matches every message, so that the tags
    say nothing about the label. `normalised` False matches the raw text instead of the normal form.
    """
    if scope not in ("flagged", "all"):
        raise ValueError(f"scope must be 'flagged' or 'all': {scope}")
    staged = text.normalise(messages, "text_raw", "norm", slang=slang)
    wanted = F.col("norm") != ""
    if scope == "flagged":
        wanted = wanted & F.col("is_flagged")
    matched = rules.with_matches(staged, "norm" if normalised else "text_raw", catalog, when=wanted, gate=gate)
    return rules.with_summary(matched, catalog)


def annotate_contacts(messages: DataFrame, catalog: Catalog = DEFAULT, *, normalised: bool = False) -> DataFrame:
    """Rule hits on external messages of a contact table (sender, text, ml_prob)."""
    column = "text"
    if normalised:
        messages = text.normalise(messages, "text", "norm")
        column = "norm"
    matched = rules.with_matches(messages, column, catalog, when=F.col("sender") == "external")
    return rules.with_summary(matched, catalog)
