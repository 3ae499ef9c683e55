"""Conversation risk: one row per conversation from its annotated messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatrisk import config
from chatrisk.functions import scoring
from chatrisk.functions.catalog import DEFAULT, Catalog
from chatrisk.functions.rules import mask_categories
from chatrisk.plans.skew import PIECE_ROWS, split_hot, with_pieces

KEY = "conv_id"
COMPONENTS = ["base", "cooccur", "escal", "arc", "dominance", "density", "consec"]


def category_counts(messages: DataFrame) -> DataFrame:
    """Messages that contain a category, per conversation and category."""
    cats = messages.select(KEY, F.explode_outer(F.array_distinct(F.col("matches.category"))).alias("category"))
    return cats.filter("category IS NOT NULL").groupBy(KEY, "category").agg(F.count(F.lit(1)).alias("msg_count"))


def weighted_counts(counts: DataFrame, weights: DataFrame) -> DataFrame:
    """Counts with the category's weight; unknown categories weigh 1."""
    joined = counts.join(F.broadcast(weights), "category", "left")  # one row per catalog category
    return joined.withColumn("weight", F.coalesce("weight", F.lit(config.DEFAULT_WEIGHT)))


def active_pairs(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of which a conversation has both categories, by two key joins."""
    seen = counts.select(KEY, "category")
    first = seen.join(F.broadcast(pairs), seen["category"] == pairs["cat_a"]).drop("category")
    return first.join(seen.withColumnRenamed("category", "cat_b"), [KEY, "cat_b"]).select(KEY, "cat_a", "cat_b", "bonus")


def message_runs(messages: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """n_runs per conversation: maximal runs of three or more adjacent flagged messages."""
    return conversation_figures(messages, piece_rows=piece_rows).select(KEY, "n_runs")


def _figures(messages: DataFrame, keys: list[str], catalog: Catalog, extra: dict[str, Column]) -> DataFrame:
    """Aggregates per key with ordinals counted within the key."""
    by = Window.partitionBy(*keys).orderBy("conv_idx")
    over = lambda sql: F.expr(sql).over(by)
    staged = messages.withColumns({
        "_own": F.expr("_scored AND NOT _halo"),
        "_s1": over("lag(_scored, 1, false)"), "_s2": over("lag(_scored, 2, false)"), "_s3": over("lag(_scored, 3, false)"),
        "_i2": over("lag(conv_idx, 2, -9)"), "_i3": over("lag(conv_idx, 3, -9)"),
    }).withColumns({
        **{own: F.expr(f"IF(_own, {column}, 0L)") for own, column in zip(
            scoring.word_names("_mask", catalog), scoring.word_names("cat_mask", catalog))},
        "_sev": F.expr("IF(_own, max_severity, 0)"),
        "_ordinal": F.expr("sum(int(_own))").over(by.rowsBetween(Window.unboundedPreceding, 0)),
        # The third message of a run of adjacent ones, each run once.
        "_third": F.expr("_own AND _s1 AND _s2 AND conv_idx - _i2 = 2 AND NOT (_s3 AND conv_idx - _i3 = 3)"),
    })
    trust = scoring.has_any("_mask", catalog.mask(catalog.trust))
    solicit = scoring.has_any("_mask", catalog.mask(catalog.solicit))
    figures = {
        "label": "max(int(is_flagged AND NOT _halo))",
        "n_messages": "count_if(_live AND NOT _halo)",
        "n_flagged": "count_if(_own)",
        "total_hits": "sum(IF(_own, n_hits, 0))",
        "n_runs": "count_if(_third)",
        **{whole: f"bit_or({own})" for whole, own in zip(
            scoring.word_names("cat_mask", catalog), scoring.word_names("_mask", catalog))},
        "_trust": f"min(IF({trust}, _ordinal, NULL))",
        "_solicit": f"max(IF({solicit}, _ordinal, NULL))",
        **{f"_first{k}": f"min(IF(_sev >= {k}, _ordinal, NULL))" for k in scoring.SEVERITIES},
        **{f"_last{k}": f"max(IF(_sev >= {k}, _ordinal, NULL))" for k in scoring.SEVERITIES},
        **{f"_n{i}": f"count_if({scoring.has_any('_mask', catalog.bit(c))})" for i, c in enumerate(catalog.categories)},
    }
    columns = [*(F.expr(f).alias(n) for n, f in figures.items()), *(e.alias(n) for n, e in extra.items())]
    return staged.groupBy(*keys).agg(*columns)


def _combine(pieces: DataFrame) -> DataFrame:
    """Piece figures to conversation figures: ordinals move up by the messages of earlier pieces."""
    earlier = Window.partitionBy(KEY).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    shifted = pieces.withColumn("_shift", F.coalesce(F.sum("n_flagged").over(earlier), F.lit(0)))
    how = {}
    for column in pieces.columns:
        if column in (KEY, "_piece"):
            continue
        if column == "label":
            how[column] = F.max(column)
        elif column.startswith("cat_mask"):
            how[column] = F.bit_or(column)
        elif column.startswith("_first") or column == "_trust":
            how[column] = F.min(F.col(column) + F.col("_shift"))
        elif column.startswith("_last") or column == "_solicit":
            how[column] = F.max(F.col(column) + F.col("_shift"))
        else:
            how[column] = F.sum(column)
    return shifted.groupBy(KEY).agg(*(c.alias(n) for n, c in how.items()))


def split_conversations(messages: DataFrame, scope: str, piece_rows: int) -> tuple[DataFrame | None, DataFrame | None]:
    """(ordinary, hot) messages, marked with what counts as a scored message."""
    scored = F.col("norm") != ""
    if scope == "flagged":
        scored = scored & F.col("is_flagged")
    marked = messages.withColumn("_scored", scored).select(
        KEY, "conv_idx", "is_flagged", "_scored", "max_severity", *(c for c in messages.columns if c.startswith("cat_mask")), "n_hits", (F.col("norm") != "").alias("_live"),
        *(["_part"] if "_part" in messages.columns else []))
    ordinary, hot = split_hot(marked, [KEY], piece_rows)
    if ordinary is not None:
        ordinary = ordinary.withColumn("_halo", F.lit(False))
    if hot is not None:
        hot = with_pieces(hot, "conv_idx", config.RUN_LENGTH, piece_rows)
    return ordinary, hot


def conversation_figures(
    messages: DataFrame, *, scope: str = "flagged", catalog: Catalog = DEFAULT, piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Counts, masks and ordinals per conversation."""
    ordinary, hot = split_conversations(messages, scope, piece_rows)
    parts = []
    if ordinary is not None:
        parts.append(_figures(ordinary, [KEY], catalog, {}))
    if hot is not None:
        parts.append(_combine(_figures(hot, [KEY, "_piece"], catalog, {})))
    return reduce(DataFrame.unionByName, parts)


def risk_columns(figures: DataFrame, *, scope: str = "flagged", catalog: Catalog = DEFAULT) -> DataFrame:
    """Add the seven components, the score and the level."""
    place = {c: i for i, c in enumerate(catalog.categories)}
    scored = figures.withColumns({name: F.expr(sql) for name, sql in {
        "base": scoring.base_score(lambda c: f"_n{place[c]}", "cat_mask", catalog),
        "cooccur": scoring.pair_score("cat_mask", catalog),
        "escal": scoring.escalation("n_flagged", lambda k: f"_first{k}", lambda k: f"_last{k}"),
        "arc": scoring.stage_arc("n_flagged", "_trust", "_solicit", "cat_mask", catalog),
        # These two compare flagged authors with the others.
        "dominance": "0D" if scope == "all" else (
            f"IF(try_divide(n_flagged, n_messages) > {config.DOMINANCE_SHARE}D, {config.DOMINANCE_BONUS}D, 0D)"),
        "consec": "0D" if scope == "all" else f"n_runs * {config.RUN_BONUS}D",
        "density": f"IF(try_divide(total_hits, n_flagged) > {config.DENSITY_LIMIT}D, {config.DENSITY_BONUS}D, 0D)",
    }.items()})
    scored = scored.withColumn("score", F.expr(" + ".join(COMPONENTS)))
    scored = scored.withColumn("level", F.expr(scoring.level_of("score")))
    helpers = [c for c in scored.columns if c.startswith("_")]
    return scored.drop(*helpers).withColumn("categories", mask_categories("cat_mask", catalog))


def conversation_risk(
    messages: DataFrame, *, scope: str = "flagged", catalog: Catalog = DEFAULT, piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Risk of every conversation; `messages` comes from `annotate_messages` with the same scope."""
    figures = conversation_figures(messages, scope=scope, catalog=catalog, piece_rows=piece_rows)
    return risk_columns(figures, scope=scope, catalog=catalog)
