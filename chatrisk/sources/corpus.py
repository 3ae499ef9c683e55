"""Readers for chat corpora, author lists, ground truth, datasets and message feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatrisk.operators.datasets import whole_texts
from chatrisk.sources import json_array, xml_elements

CONVERSATION_SCHEMA = T.StructType([
    T.StructField("_id", T.StringType()),
    T.StructField("message", T.ArrayType(T.StructType([
        T.StructField("author", T.StringType()),
        T.StructField("text", T.StringType()),
    ]))),
])
RECORD_SCHEMA = "conversation_id STRING, part INT, n_parts INT, text STRING, label INT"
FEED_SCHEMA = "contact_id BIGINT, ts TIMESTAMP, msg_id BIGINT, sender STRING, text STRING, ml_prob DOUBLE, reset BOOLEAN"

MESSAGE_KEY = ["contact_id", "msg_id"]
#: Files of a micro-batch unless the caller sets another number.
FILES_PER_BATCH = 64


def _strip(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(r"(?U)^\s+|\s+$"), F.lit(""))


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """conv_id and messages of every conversation element, in document order; malformed XML is an error."""
    raw = spark.read.format("xml").option("rowTag", "conversation").option("mode", "FAILFAST").schema(CONVERSATION_SCHEMA).load(path)
    return raw.select(_strip(F.col("_id")).alias("conv_id"), F.col("message").alias("messages"))


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """conv_id, conv_idx, author, text_raw: one row per message, missing parts as empty text.

    A conversation without messages has one row with an empty text and no author, so it stays a record.
    """
    placed = read_conversations(spark, path).select("conv_id", F.posexplode_outer("messages").alias("conv_idx", "m"))
    return placed.select(
        "conv_id", F.coalesce("conv_idx", F.lit(0)).alias("conv_idx"),
        F.when(F.col("conv_idx").isNotNull(), _strip(F.col("m.author"))).alias("author"), _strip(F.col("m.text")).alias("text_raw"))


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Messages as `read_messages` gives them, with a `conv_key` for every conversation element.

    Elements that share an id, or have none (conv_id ''), stay apart by their key; use it in place of conv_id where a
    record per element is wanted. Files are split, and an element may span any number of splits.
    """
    rows = xml_elements.read_elements(spark, path)
    return rows.select(
        "conv_key", _strip(F.col("conv_id")).alias("conv_id"), "conv_idx",
        F.when(F.col("author").isNotNull(), _strip(F.col("author"))).alias("author"), _strip(F.col("text_raw")).alias("text_raw"))


def read_array_records(spark: SparkSession, path: str) -> DataFrame:
    """Dataset records, parts included, from files that are one JSON array each; files are split at record ends."""
    return json_array.read_json_array(spark, path, RECORD_SCHEMA)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    stripped = spark.read.text(path).select(_strip(F.col("value")).alias("line"))
    return stripped.filter((F.col("line") != "") & ~F.col("line").startswith("#"))


def read_authors(spark: SparkSession, path: str) -> DataFrame:
    """author_id, one per line; blank lines and # comments skipped, duplicates removed."""
    return _lines(spark, path).select(F.col("line").alias("author_id")).distinct()


def _truth_fields(spark: SparkSession, path: str) -> DataFrame:
    tabbed = F.split("line", "\t", -1)
    fields = F.when(F.size(tabbed) >= 2, tabbed).otherwise(F.split("line", r"(?U)\s+", -1))
    return _lines(spark, path).select(fields.alias("f"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(conv_id, author_id) per line, by tab or else by white space; shorter lines are skipped."""
    return _truth_fields(spark, path).filter(F.size("f") >= 2).select(
        _strip(F.col("f")[0]).alias("conv_id"), _strip(F.col("f")[1]).alias("author_id")).distinct()


def skipped_truth_lines(spark: SparkSession, path: str) -> DataFrame:
    """How many lines were too short: a file with one column has no usable line at all."""
    return _truth_fields(spark, path).agg(F.count_if(F.size("f") < 2).alias("skipped"))


def read_records(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Dataset records from a JSON array file, or from JSON lines, which can be split. Broken JSON is an error.

    Parts of a conversation, where the file has them, are joined to one record.
    """
    raw = spark.read.schema(RECORD_SCHEMA).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    return whole_texts(raw)


def read_feed(
    spark: SparkSession, path: str, files_per_batch: int = FILES_PER_BATCH, fmt: str = "parquet", *,
    redelivered: bool = False, within: str | None = None, schema: str = FEED_SCHEMA,
) -> DataFrame:
    """Stream of contact messages from a folder; `files_per_batch` bounds a micro-batch.

    A source that may deliver a message again is read with `redelivered`: of rows with the same contact and message id
    the first one counts. Their ids are kept for good, or, with `within`, as long as a message comes no later than that
    after the newest one; rows older still are late and do not count.
    """
    feed = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(path)
    if not redelivered:
        return feed
    if within is None:
        return feed.dropDuplicates(MESSAGE_KEY)
    return feed.withWatermark("ts", within).dropDuplicatesWithinWatermark(MESSAGE_KEY)
