"""Annotated training texts and their splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatrisk import config
from chatrisk.functions import rules
from chatrisk.functions.catalog import DEFAULT, Catalog
from chatrisk.operators import conversations as conv
from chatrisk.operators.messages import annotate_messages, role_tag
from chatrisk.plans.checkpoints import checkpointed
from chatrisk.plans.joins import lookup_join
from chatrisk.plans.skew import PIECE_ROWS

PREFIX = r"\[RISK:[A-Z]+\] \[CATS:[^\]]*\] \[ESC:[01]\] \[ARC:[01]\] \[DOM:[01]\]"
BUCKET_DIGITS = 5  # 16 ** 5 buckets of the split key


def message_part(scope: str = "flagged") -> Column:
    """Role, rule tags and text of one message."""
    tags = F.array_join(
        F.transform(rules.rule_tags(), lambda t: F.concat(
            F.lit("[RULE:"), t["category"], F.lit(":"), t["severity"].cast("string"), F.lit("]"))), " ")
    role = role_tag() if scope == "flagged" else F.lit("[USER]")
    return F.concat(role, F.lit(" "), F.when(tags == "", F.lit("")).otherwise(F.concat(tags, F.lit(" "))), F.col("norm"))


def prefix_tokens() -> Column:
    """Level, categories and signal flags in front of the text."""
    flag = lambda token, column: F.concat(F.lit(f" [{token}:"), (F.col(column) > 0).cast("int"), F.lit("]"))
    cats = F.array_join("categories", ",")
    return F.concat(
        F.lit("[RISK:"), F.col("level"), F.lit("] [CATS:"), F.when(cats == "", F.lit("none")).otherwise(cats), F.lit("]"),
        flag("ESC", "escal"), flag("ARC", "arc"), flag("DOM", "dominance"),
    )


def annotated_texts(
    messages: DataFrame, *, scope: str = "flagged", catalog: Catalog = DEFAULT, piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """conversation_id, part, n_parts, text, label and the risk columns.

    A conversation is one row, made in the shuffle that scores it. One with more than `piece_rows`
    messages is several rows, whose texts in order of `part`, joined by the separator, are the whole.
    """
    staged = messages.withColumn("_part", F.when(F.col("norm") != "", message_part(scope)))
    ordinary, hot = conv.split_conversations(staged, scope, piece_rows)
    body = F.array_sort(F.collect_list(
        F.when(F.col("_part").isNotNull() & ~F.col("_halo"), F.struct("conv_idx", F.col("_part").alias("part")))))
    joined = F.array_join(F.col("body.part"), config.SEPARATOR)
    outputs = []
    if ordinary is not None:
        figures = conv._figures(ordinary, [conv.KEY], catalog, {"body": body})
        whole = conv.risk_columns(figures, scope=scope, catalog=catalog)
        text = F.concat_ws(" ", prefix_tokens(), F.when(F.size("body") > 0, joined))
        outputs.append(whole.withColumns({"part": F.lit(0), "n_parts": F.lit(1), "text": text}).drop("body"))
    if hot is not None:
        pieces = conv._figures(hot, [conv.KEY, "_piece"], catalog, {"body": body})
        risk = conv.risk_columns(conv._combine(pieces.drop("body")), scope=scope, catalog=catalog)
        numbers = pieces.groupBy(conv.KEY).agg(F.max("_piece").alias("_last"))
        texts = pieces.select(conv.KEY, F.col("_piece").cast("int").alias("part"), joined.alias("text"))
        parts = lookup_join(texts, risk.join(numbers, conv.KEY), [conv.KEY], "inner")
        text = F.when(F.col("part") == 0, F.concat_ws(" ", prefix_tokens(), F.nullif("text", F.lit("")))).otherwise(F.col("text"))
        outputs.append(parts.withColumn("n_parts", (F.col("_last") + 1).cast("int")).withColumn("text", text).drop("_last"))
    return reduce(DataFrame.unionByName, outputs).withColumnRenamed(conv.KEY, "conversation_id")


def dataset_columns(texts: DataFrame) -> DataFrame:
    return texts.select("conversation_id", "part", "n_parts", "text", "label")


def whole_texts(dataset: DataFrame) -> DataFrame:
    """One record per conversation, at any size, without part and n_parts.

    Parts, also as read from files, are joined by the separator; those without a message give none. Records
    without part or of one part pass as they are.
    """
    if "n_parts" not in dataset.columns:
        return dataset
    is_part = F.coalesce(F.col("n_parts") > 1, F.lit(False))
    rest = [c for c in dataset.columns if c not in ("conversation_id", "part", "n_parts", "text")]
    texts = F.array_sort(F.collect_list(F.struct("part", "text")))
    joined = F.array_join(F.filter(F.transform(texts, lambda t: t["text"]), lambda t: t != ""), config.SEPARATOR)
    # A first part without a message is the prefix alone.
    text = F.regexp_replace(joined, F.lit(f"^({PREFIX}){config.SEPARATOR.replace('[', chr(92) + '[').replace(']', chr(92) + ']')}"), F.lit("$1 "))
    merged = dataset.filter(is_part).groupBy("conversation_id").agg(
        *[F.min_by(c, "part").alias(c) for c in rest], text.alias("text"))
    columns = [c for c in dataset.columns if c not in ("part", "n_parts")]
    return dataset.filter(~is_part).select(*columns).unionByName(merged.select(*columns))


def build_dataset(
    messages: DataFrame, *, scope: str = "flagged", catalog: Catalog = DEFAULT, slang=None,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Flagged messages to dataset records: normalise, match, score, annotate."""
    annotated = annotate_messages(messages, scope=scope, catalog=catalog, slang=slang)
    return dataset_columns(annotated_texts(annotated, scope=scope, catalog=catalog, piece_rows=piece_rows))


def split_key(id_column: str, seed: int) -> Column:
    """Pseudo-random text that orders rows the same way on every run."""
    return F.md5(F.concat_ws("|", F.col(id_column).cast("string"), F.lit(str(seed))))


def split_by_hash(df: DataFrame, id_column: str = "conversation_id", ratio: float = config.VAL_RATIO, seed: int = config.SEED) -> DataFrame:
    """Add split val or train from the row's own key: no shuffle, shares hold on average."""
    draw = F.conv(F.substring(split_key(id_column, seed), 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))
    return df.withColumn("split", F.when(draw < ratio, "val").otherwise("train"))


def split_exact(
    df: DataFrame, id_column: str = "conversation_id", label: str = "label",
    ratio: float = config.VAL_RATIO, seed: int = config.SEED,
) -> DataFrame:
    """Add split with exactly round(ratio * n) rows of every label in val; ids are unique per row or part.

    The last val key of each label is found from counts per key prefix, then among the few rows
    sharing that prefix, so no label is ever ranked in one task.
    """
    keyed = df.withColumn("_key", F.struct(split_key(id_column, seed).alias("h"), F.col(id_column).cast("string").alias("id")))
    ids = keyed.filter("part = 0") if "part" in df.columns else keyed
    # Read three times, so the keys and labels are written; texts are not.
    ids = checkpointed(
        ids.select(F.col(label).alias("_label"), "_key", F.substring(F.col("_key.h"), 1, BUCKET_DIGITS).alias("_bucket")), "split-keys")
    sizes = ids.groupBy("_label", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("_label").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("_label")
    sizes = sizes.withColumns({"_upto": F.sum("_n").over(upto), "_wanted": F.floor(F.sum("_n").over(whole) * ratio + 0.5)})
    edges = sizes.filter((F.col("_upto") >= F.col("_wanted")) & (F.col("_upto") - F.col("_n") < F.col("_wanted"))).select(
        "_label", "_bucket", (F.col("_wanted") - F.col("_upto") + F.col("_n")).alias("_take"))
    nearby = ids.join(F.broadcast(edges), ["_label", "_bucket"])  # at most one edge per label
    rank = F.row_number().over(Window.partitionBy("_label").orderBy("_key"))
    cuts = nearby.withColumn("_rank", rank).filter("_rank = _take").select(
        F.col("_label").alias(label), F.col("_key").alias("_cut"))
    return keyed.join(F.broadcast(cuts), label, "left").withColumn(
        "split", F.when(F.col("_key") <= F.col("_cut"), "val").otherwise("train")).drop("_key", "_cut")


def union_splits(train_and_val: DataFrame, test: DataFrame) -> DataFrame:
    return train_and_val.unionByName(test.withColumn("split", F.lit("test")))


def split_statistics(dataset: DataFrame) -> DataFrame:
    """Rows, positives, positive share and negatives per split."""
    return dataset.groupBy("split").agg(
        F.count(F.lit(1)).alias("total"), F.sum("label").alias("pos"),
        F.round(F.avg("label") * 100, 6).alias("pos_pct"), F.sum(1 - F.col("label")).alias("neg"))


def positive_rate(dataset: DataFrame) -> DataFrame:
    return dataset.agg(F.sum("label").alias("pos"), F.round(F.avg("label") * 100, 6).alias("pos_pct"))
