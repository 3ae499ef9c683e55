"""Annotated texts back to metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Token patterns of the annotated text, and the order of the levels.
# ---------------------------------------------------------------------------
RISK = r"\[RISK:(HIGH|MEDIUM|LOW)\]"
CATS = r"\[CATS:([^\]]*)\]"
ESC = r"\[ESC:([01])\]"
ARC = r"\[ARC:([01])\]"
DOM = r"\[DOM:([01])\]"
RULE = r"\[RULE:([a-z_]+):([123])\]"
SEP = r" \[SEP\] "
RISK_ORDER = {"HIGH": 3, "MEDIUM": 2, "LOW": 1, "UNKNOWN": 0}


def strip(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?U)^\s+|\s+$"), F.lit(""))


def label_string(label: str = "label") -> Column:
    return F.when(F.col(label) == 1, "GROOMING").otherwise("benign")


def risk_order(level: str = "risk_level") -> Column:
    order = F.lit(0)
    for value, rank in RISK_ORDER.items():
        order = F.when(F.col(level) == value, F.lit(rank)).otherwise(order)
    return order


def with_prefix(dataset: DataFrame) -> DataFrame:
    """Add risk_level, risk_order, escalation, arc, dominance, categories, n_categories."""
    flag = lambda pattern: F.regexp_extract("text", pattern, 1) == "1"
    return dataset.withColumns({
        "label_str": label_string(),
        "risk_level": F.coalesce(F.nullif(F.regexp_extract("text", RISK, 1), F.lit("")), F.lit("UNKNOWN")),
        "escalation": flag(ESC), "arc": flag(ARC), "dominance": flag(DOM),
        "categories": F.filter(F.split(F.regexp_extract("text", CATS, 1), ","), lambda c: ~c.isin("", "none")),
    }).withColumns({"risk_order": risk_order(), "n_categories": F.size("categories")})


def _tags(part: Column) -> Column:
    names = F.regexp_extract_all(part, F.lit(RULE), F.lit(1))
    severities = F.regexp_extract_all(part, F.lit(RULE), F.lit(2))
    return F.zip_with(names, severities, lambda n, s: F.struct(n.alias("category"), s.cast("int").alias("severity")))


def with_messages(dataset: DataFrame) -> DataFrame:
    """Add messages: role, text and rule tags of every part of the body."""
    body = F.col("text")
    for pattern in (RISK, CATS, ESC, ARC, DOM):
        body = F.regexp_replace(body, F.lit(pattern), F.lit(""))
    parts = F.filter(F.transform(F.split(strip(body), SEP, -1), strip), lambda p: p != "")

    def message(part: Column) -> Column:
        clean = strip(F.regexp_replace(part, F.lit(RULE), F.lit("")))
        return F.struct(
            F.when(clean.startswith("[PRED]"), "PRED").otherwise("USER").alias("role"),
            strip(F.regexp_replace(clean, F.lit(r"(?U)^\[(PRED|USER)\]\s*"), F.lit(""))).alias("text"),
            _tags(part).alias("rules"),
        )

    return dataset.withColumn("messages", F.transform(parts, message))


def _counted(parsed: DataFrame) -> DataFrame:
    rules = F.flatten(F.col("messages.rules"))
    parsed = parsed.withColumn("_rules", rules).withColumn("_names", F.array_distinct(F.col("_rules.category")))
    return parsed.withColumns({
        "cat_counts": F.map_from_arrays("_names", F.transform("_names", lambda n: F.size(
            F.filter("_rules", lambda r: r["category"] == n)))),
        "total_rule_hits": F.size("_rules"),
        "sev3_hits": F.size(F.filter("_rules", lambda r: r["severity"] == 3)),
        "n_messages": F.size("messages"),
    }).drop("_rules", "_names", "text")


def _joined_parts(parsed: DataFrame) -> DataFrame:
    """Rows of parts as one row per conversation: the columns of the first part, the messages of all."""
    is_part = F.coalesce(F.col("n_parts") > 1, F.lit(False))
    rest = [c for c in parsed.columns if c not in ("conversation_id", "part", "n_parts", "messages")]
    pieces = F.array_sort(F.collect_list(F.struct("part", "messages")))
    merged = parsed.filter(is_part).groupBy("conversation_id").agg(
        *[F.min_by(c, "part").alias(c) for c in rest], F.flatten(F.transform(pieces, lambda p: p["messages"])).alias("messages"))
    return parsed.filter(~is_part).drop("part", "n_parts").unionByName(merged)


def parse_records(dataset: DataFrame) -> DataFrame:
    """The metadata and messages of every record, one row per conversation; parts are parsed apart and joined."""
    parsed = with_messages(with_prefix(dataset)).drop("text")
    return _counted(_joined_parts(parsed) if "n_parts" in dataset.columns else parsed)


def parsed_parts(dataset: DataFrame) -> DataFrame:
    """(conversation_id, part, messages): every part's own messages, not joined to one row."""
    parted = dataset if "part" in dataset.columns else dataset.withColumn("part", F.lit(0))
    return with_messages(parted).select("conversation_id", "part", "messages")


def slim_records(dataset: DataFrame) -> DataFrame:
    """One row of metadata per conversation, without its messages.

    Conversations of one part, which is nearly all of them, need no shuffle for this.
    """
    parsed = _counted(with_messages(with_prefix(dataset)))
    if "n_parts" not in dataset.columns:
        return parsed.drop("messages")
    is_part = F.coalesce(F.col("n_parts") > 1, F.lit(False))
    single = parsed.filter(~is_part).drop("messages", "part", "n_parts")
    several = parsed.filter(is_part)
    first = lambda c: F.max_by(c, F.struct(-F.col("part"))).alias(c)
    # One entry per category, in the order in which categories first appear over the parts.
    counts = several.select("conversation_id", "part", F.posexplode("cat_counts").alias("_at", "category", "n")).groupBy(
        "conversation_id", "category").agg(
        F.min(F.struct("part", "_at")).alias("_first"), F.sum("n").cast("int").alias("n")).groupBy("conversation_id").agg(
        F.array_sort(F.collect_list(F.struct("_first", "category", "n"))).alias("_entries")).select(
        "conversation_id", F.map_from_arrays("_entries.category", "_entries.n").alias("cat_counts"))
    head = [c for c in single.columns if c not in (
        "conversation_id", "cat_counts", "total_rule_hits", "sev3_hits", "n_messages")]
    merged = several.groupBy("conversation_id").agg(
        *[first(c) for c in head],
        *[F.sum(c).cast("int").alias(c) for c in ("total_rule_hits", "sev3_hits", "n_messages")],
    ).join(counts, "conversation_id", "left").withColumn(
        "cat_counts", F.coalesce("cat_counts", F.create_map().cast("map<string,int>")))
    return single.unionByName(merged)
