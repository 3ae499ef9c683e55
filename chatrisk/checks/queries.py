"""The registered queries: name -> (spark, sf_dir) -> DataFrame, with their DuckDB counterparts."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatrisk import views
from chatrisk.checks import oracle as o
from chatrisk.functions import catalog_table, rules, text
from chatrisk.functions.catalog import DEFAULT, Catalog
from chatrisk.operators import (
    classifier, contacts, conversations, datasets, evaluation, messages, records, reports, trainer,
)
from chatrisk.plans.checkpoints import checkpointed, scratch_path
from chatrisk.plans.session import tune
from chatrisk.plans.spread import spread_small
from chatrisk.sources import corpus, sinks
from chatrisk.streaming import alerts as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
WINDOW_KEYS = ["contact_id"]
WINDOW_ORDER = ["ts", "msg_id"]


def query(sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = lambda spark, sf_dir: function(tune(spark), sf_dir)
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return register


def joined(column: str, separator: str = ",") -> Column:
    return F.array_join(column, separator)


def flagged_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.flag_by_author(views.conversation_messages(spark, sf_dir), views.flagged_authors(spark, sf_dir))


def annotated(spark: SparkSession, sf_dir: str, scope: str = "flagged") -> DataFrame:
    return messages.annotate_messages(flagged_messages(spark, sf_dir), scope=scope)


def dataset(spark: SparkSession, sf_dir: str, scope: str = "flagged") -> DataFrame:
    return datasets.dataset_columns(datasets.annotated_texts(annotated(spark, sf_dir, scope), scope=scope))


def slim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.slim_records(dataset(spark, sf_dir))


def contact_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.annotate_contacts(views.contact_messages(views.read_table(spark, sf_dir, "events")))


def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.with_window(contact_annotated(spark, sf_dir), WINDOW_KEYS, WINDOW_ORDER)


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.read_table(spark, sf_dir, "documents")
    scores = docs.select(F.col("doc_id").alias("id"), ((F.col("n_chars") % 1000) / 1000.0).alias("prob"))
    labels = views.read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    return evaluation.align_scores(labels, scores, "id")


# --- messages, joins, labels ------------------------------------------------

FULL_WIDTH = ("".join(map(chr, range(0x21, 0x7F))), "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)))


@query("SELECT doc_id, md5(nfc_normalize(text)) AS composed FROM documents")
def full_width_documents(spark, sf_dir):
    """Texts whose ASCII signs were written in full width: the compatible composed form brings them back."""
    wide = F.translate("text", *FULL_WIDTH)
    return views.read_table(spark, sf_dir, "documents").select("doc_id", F.md5(text.nfkc(wide)).alias("composed"))


@query(o.sql(o.CHAT, "SELECT conv_id, conv_idx, author, text_raw FROM msg"))
def messages_indexed(spark, sf_dir):
    rows = views.conversation_rows(views.read_table(spark, sf_dir, "events"))
    return messages.index_messages(rows, ["conv_id"], ["ts", "event_id"]).drop("ts", "event_id")


@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS conv_idx, role FROM conversations")
def turns_indexed(spark, sf_dir):
    turns = views.read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return messages.index_messages(turns, ["conv_id"], ["turn"])


@query(o.sql(o.CHAT, "SELECT conv_id, conv_idx, author, is_flagged FROM msg"))
def author_flags(spark, sf_dir):
    return flagged_messages(spark, sf_dir).select("conv_id", "conv_idx", "author", "is_flagged")


@query(o.sql(o.CHAT, "SELECT conv_id, conv_idx, author, is_flagged FROM msg"))
def truth_flags(spark, sf_dir):
    flagged = messages.flag_by_truth(views.conversation_messages(spark, sf_dir), views.flagged_pairs(spark, sf_dir))
    return flagged.select("conv_id", "conv_idx", "author", "is_flagged")


@query(o.sql(o.CHAT, "SELECT DISTINCT conv_id FROM msg WHERE is_flagged"))
def flagged_conversations(spark, sf_dir):
    return messages.flagged_conversations(flagged_messages(spark, sf_dir))


@query(o.sql(o.CHAT, "SELECT conv_id, max(CAST(is_flagged AS INTEGER)) AS label FROM msg GROUP BY 1"))
def conversation_labels(spark, sf_dir):
    return messages.conversation_labels(flagged_messages(spark, sf_dir))


@query(o.sql(o.CHAT_HITS, """SELECT conv_id, conv_idx, CASE WHEN is_flagged THEN '[PRED]' ELSE '[USER]' END AS role, norm FROM live"""))
def role_tagged_messages(spark, sf_dir):
    live = text.drop_empty(text.normalise(flagged_messages(spark, sf_dir)))
    return live.select("conv_id", "conv_idx", messages.role_tag().alias("role"), "norm")


@query("""SELECT conv_id, round(avg(CASE WHEN role = 'user' THEN 1.0 ELSE 0.0 END), 6) AS user_share,
CAST(count(*) AS BIGINT) AS n FROM conversations WHERE trim(text) <> '' GROUP BY 1""")
def turn_shares(spark, sf_dir):
    turns = text.drop_empty(text.normalise(views.read_table(spark, sf_dir, "conversations"), "text"))
    return turns.groupBy("conv_id").agg(
        F.round(F.avg((F.col("role") == "user").cast("double")), 6).alias("user_share"), F.count(F.lit(1)).alias("n"))


# --- text ---------------------------------------------------------------------

@query(o.sql(o.normalised("documents", "doc_id", "text", "nd"), "SELECT doc_id, norm FROM nd WHERE norm <> ''"))
def normalised_documents(spark, sf_dir):
    docs = spread_small(views.read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return text.drop_empty(text.normalise(docs, "text")).select("doc_id", "norm")


@query(o.sql(["turns AS (SELECT conv_id * 1000 + turn AS k, text FROM conversations)", *o.normalised("turns", "k", "text", "nt")],
             "SELECT k, norm FROM nt"))
def normalised_turns(spark, sf_dir):
    turns = views.read_table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text")
    return text.normalise(turns, "text").select("k", "norm")


@query("SELECT doc_id, lower(nfc_normalize(text)) AS lowered FROM documents")
def lowered_documents(spark, sf_dir):
    return views.read_table(spark, sf_dir, "documents").withColumn("composed", text.nfkc(F.col("text"))).select(
        "doc_id", F.lower("composed").alias("lowered"))


@query("""SELECT page_id, regexp_replace(lower(url), 'https?://\\S+|www\\.\\S+', '<URL>', 'g') AS masked,
regexp_replace('see ' || lower(url) || ' for more', 'https?://\\S+|www\\.\\S+', '<URL>', 'g') AS sentence FROM pages""")
def masked_urls(spark, sf_dir):
    return views.read_table(spark, sf_dir, "pages").select(
        "page_id", text.mask_urls(F.lower("url")).alias("masked"),
        text.mask_urls(F.concat(F.lit("see "), F.lower("url"), F.lit(" for more"))).alias("sentence"))


@query(r"""SELECT doc_id, (length(m) - length(replace(m, '<EMAIL>', ''))) // 7 AS n_emails, (length(m) - length(replace(m, '<PHONE>', ''))) // 7 AS n_phones, length(m) AS n, m AS masked FROM
(SELECT doc_id, regexp_replace(regexp_replace(lower(text), '\b[\w.+-]+@[\w-]+\.[a-z]{2,}\b', '<EMAIL>', 'g'), '\b\d[\d\s\-]{5,13}\d\b', '<PHONE>', 'g') AS m FROM documents)""")
def masked_contacts(spark, sf_dir):
    masked = text.mask_emails(F.col("low"))
    docs = views.read_table(spark, sf_dir, "documents").withColumn("low", F.lower("text")).withColumn("mail", masked)
    docs = docs.withColumn("m", text.mask_phones(F.col("mail")))
    return docs.select(
        "doc_id", F.regexp_count("m", F.lit("<EMAIL>")).cast("bigint").alias("n_emails"),
        F.regexp_count("m", F.lit("<PHONE>")).cast("bigint").alias("n_phones"), F.length("m").cast("bigint").alias("n"), F.col("m").alias("masked"))


@query("""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS c, generate_subscripts(regexp_extract_all(text, '(?s).'), 1) AS pos FROM documents),
l AS (SELECT *, lag(c, 1) OVER w AS c1, lag(c, 2) OVER w AS c2 FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
k AS (SELECT doc_id, string_agg(c, '' ORDER BY pos) AS kept FROM l WHERE NOT (c <> chr(10) AND c = coalesce(c1, '') AND c = coalesce(c2, '')) GROUP BY 1)
SELECT doc_id, coalesce(kept, text) AS collapsed FROM documents LEFT JOIN k USING (doc_id)""")
def collapsed_repeats(spark, sf_dir):
    docs = views.read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.collapse_repeats(F.col("text")).alias("collapsed"))


@query(o.sql([o.SLANG, f"""w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{o.WORD}')) AS w, generate_subscripts(regexp_extract_all(lower(text), '{o.WORD}'), 1) AS pos FROM documents)"""],
             """SELECT doc_id, coalesce(joined, text) AS expanded FROM documents LEFT JOIN (
SELECT doc_id, string_agg(coalesce(meaning, w), '' ORDER BY pos) AS joined FROM w LEFT JOIN slang ON w = word GROUP BY 1) USING (doc_id)"""))
def expanded_slang(spark, sf_dir):
    docs = views.read_table(spark, sf_dir, "documents").withColumn("low", F.lower("text"))
    return docs.select("doc_id", text.expand_slang(F.col("low")).alias("expanded"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS spaced FROM documents")
def collapsed_spaces(spark, sf_dir):
    return views.read_table(spark, sf_dir, "documents").select("doc_id", text.collapse_spaces(F.col("text")).alias("spaced"))


# --- rules --------------------------------------------------------------------

HIT_COLUMNS = "conv_id, conv_idx, rule_id, CAST(hit_no AS INTEGER) AS hit_no, category, severity, text"


@query(o.sql([*o.CHAT_HITS, *o.scored_ctes("flagged")], f"SELECT {HIT_COLUMNS} FROM hits"))
def rule_hits(spark, sf_dir):
    return rules.explode_hits(annotated(spark, sf_dir), "conv_id", "conv_idx")


@query(o.sql([o.RULES, f"""d AS (SELECT doc_id, text || ' ' || {o.pick(views.DOUBLE, 'doc_id % 4')} || '. ' || {o.pick(views.SINGLE, 'doc_id % 12')} AS t FROM documents)""",
              "h AS (SELECT doc_id, rule_id, category, severity, t, unnest(regexp_extract_all(t, pattern, 0, 'i')) AS text FROM d, rules)"],
             "SELECT doc_id, rule_id, category, severity, text, CAST(strpos(t, text) - 1 AS INTEGER) AS first_at FROM h"))
def document_rule_hits(spark, sf_dir):
    docs = spread_small(views.read_table(spark, sf_dir, "documents")).select("doc_id", F.concat_ws(
        "", F.col("text"), F.lit(" "), views._pick(views.DOUBLE, F.col("doc_id") % 4), F.lit(". "),
        views._pick(views.SINGLE, F.col("doc_id") % 12)).alias("t"))
    hits = rules.explode_hits(rules.with_matches(docs, "t"), "doc_id", "t").drop("hit_no")
    return hits.withColumn("first_at", F.expr("instr(t, text)") - 1).drop("t")


# Every hit of a document by its place: the shortest beginning of the text that holds as many hits as come before it.
@query("""WITH hits AS (SELECT doc_id, text AS t, unnest(string_split_regex(text, '[0-9]+')) AS gap,
generate_subscripts(string_split_regex(text, '[0-9]+'), 1) AS k FROM documents),
nums AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS hit, generate_subscripts(regexp_extract_all(text, '[0-9]+'), 1) AS k FROM documents),
sums AS (SELECT doc_id, h.k, hit, sum(length(gap)) OVER w + coalesce(sum(length(hit)) OVER (PARTITION BY doc_id ORDER BY h.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
FROM hits h JOIN nums USING (doc_id, k) WINDOW w AS (PARTITION BY doc_id ORDER BY h.k))
SELECT doc_id, hit AS text, CAST(place AS INTEGER) AS "start", CAST(place + length(hit) AS INTEGER) AS "end" FROM sums""")
def document_rule_spans(spark, sf_dir):
    """Places of many hits of one rule in long texts."""
    numbers = Catalog((("number", 1, "[0-9]+"),))
    docs = spread_small(views.read_table(spark, sf_dir, "documents")).select("doc_id", F.col("text").alias("t"))
    spans = rules.explode_hits(rules.with_matches(docs, "t", numbers, spans=True, gate=False), "doc_id")
    return spans.select("doc_id", "text", "start", "end")


@query(o.sql(o.CHAT_HITS, """SELECT conv_id, conv_idx, rule_id, text, CAST(strpos(norm, text) - 1 AS INTEGER) AS "start",
CAST(strpos(norm, text) - 1 + length(text) AS INTEGER) AS "end" FROM live JOIN text_hits USING (norm)"""))
def rule_spans(spark, sf_dir):
    rows = text.normalise(views.conversation_messages(spark, sf_dir))
    spans = rules.explode_hits(rules.with_matches(rows, "norm", spans=True), "conv_id", "conv_idx")
    return spans.select("conv_id", "conv_idx", "rule_id", "text", "start", "end")


@query(o.sql(o.CHAT_HITS, """SELECT conv_id, conv_idx, rule_id, text, pattern FROM live JOIN text_hits h USING (norm) JOIN rules USING (rule_id)"""))
def hit_patterns(spark, sf_dir):
    rows = text.normalise(views.conversation_messages(spark, sf_dir))
    hits = rules.explode_hits(rules.with_matches(rows, "norm"), "conv_id", "conv_idx")
    return rules.with_patterns(hits, DEFAULT.to_df(spark)).select("conv_id", "conv_idx", "rule_id", "text", "pattern")


@query(o.sql([*o.CHAT_HITS, *o.scored_ctes("flagged")],
             """SELECT conv_id, conv_idx, CAST(count(h.rule_id) AS INTEGER) AS n_hits, CAST(coalesce(max(severity), 0) AS INTEGER) AS max_severity,
             coalesce(bool_or(severity = 3), false) AS critical, coalesce(string_agg(DISTINCT category, ',' ORDER BY category), '') AS categories
             FROM live LEFT JOIN hits h USING (conv_id, conv_idx) GROUP BY 1, 2"""))
def rule_summary(spark, sf_dir):
    return text.drop_empty(annotated(spark, sf_dir)).select(
        "conv_id", "conv_idx", "n_hits", "max_severity", "critical", F.array_join(rules.categories(), ",").alias("categories"))


CUSTOM = Catalog((
    ("school", 1, r"\bschool\b"), ("reading", 2, r"\b(book|books)\b"), ("reading", 1, r"finish\s+the\s+\w+"),
    ("numbers", 3, r"\b\w*number\w*\b"), ("school", 3, r"what\s+school"),
), weights={"school": 2.0}, pairs=(("school", "reading", 1.0),), trust=("reading",), solicit=("numbers",), control=())


@query(o.sql([*o.CHAT, f"cr(rule_id, category, severity, pattern) AS ({o.values([(i, *r) for i, r in enumerate(CUSTOM.rules)])})",
              "th AS (SELECT t, rule_id, category, severity, unnest(regexp_extract_all(t, pattern, 0, 'i')) AS text FROM (SELECT DISTINCT text_raw AS t FROM msg), cr)"],
             "SELECT conv_id, conv_idx, rule_id, category, severity, text FROM msg JOIN th ON t = text_raw"))
def custom_catalog_hits(spark, sf_dir):
    rows = rules.with_matches(views.conversation_messages(spark, sf_dir), "text_raw", CUSTOM)
    return rules.explode_hits(rows, "conv_id", "conv_idx").drop("hit_no")


# A category per word beside the fixed rules: more of them than one BIGINT has bits.
WIDE_WORDS = """family number beautiful pic parents wearing walk old promised school date meet home mom need finish book just age
you are the did what when how me send than better understand your is so tell do go to would someone older up alone let don""".split()
WIDE = Catalog(
    (*DEFAULT.rules, *((f"word_{w}", 1 + i % 2, rf"\b{w}\b") for i, w in enumerate(WIDE_WORDS))),
    weights=DEFAULT.weights | {"word_book": 0.25, "word_home": 0.5, "word_you": 0.125},
    pairs=(*DEFAULT.pairs, ("word_book", "word_did", 0.5), ("isolation", "word_tell", 0.25), ("word_age", "word_number", 0.75)),
)
WIDE_CTES = [
    f"rules(rule_id, category, severity, pattern) AS ({o.values([(i, *r) for i, r in enumerate(WIDE.rules)])})",
    f"weights(category, weight) AS ({o.values(WIDE.weights.items())})", f"pairs(cat_a, cat_b, bonus) AS ({o.values(WIDE.pairs)})",
]


# A word and what follows it: 2,303 rules in 150 categories, kept as a table.
TABLE_RULES = [
    (k, f"c{k % 150}", 1 + k % 3, pattern) for k, pattern in enumerate(
        [rf"\b{w}\s+\w{{{n}}}\b" for w in WIDE_WORDS for n in range(1, 10)] + [rf"\b{w}\b.{{{n}}}" for w in WIDE_WORDS for n in range(1, 41)])
]


@query(o.sql([*o.CHAT, f"tr(rule_id, category, severity, pattern) AS ({o.values(TABLE_RULES)})",
              "texts AS (SELECT DISTINCT text_raw AS t FROM msg)",
              "th AS (SELECT t, rule_id, category, severity, unnest(regexp_extract_all(t, pattern, 0, 'i')) AS hit FROM texts, tr)",
              """ts AS (SELECT t, count(*) AS n_hits, sum(rule_id) AS rule_sum, sum(length(hit)) AS n_chars, max(severity) AS max_severity,
              count(DISTINCT category) AS n_categories FROM th GROUP BY 1)"""],
             """SELECT conv_id, conv_idx, CAST(coalesce(n_hits, 0) AS INTEGER) AS n_hits, CAST(coalesce(rule_sum, 0) AS BIGINT) AS rule_sum,
             CAST(coalesce(n_chars, 0) AS BIGINT) AS n_chars, CAST(coalesce(max_severity, 0) AS INTEGER) AS max_severity,
             CAST(coalesce(n_categories, 0) AS INTEGER) AS n_categories FROM msg LEFT JOIN ts ON t = text_raw"""))
def table_catalog_hits(spark, sf_dir):
    path = scratch_path(spark, "catalog")
    spark.createDataFrame(TABLE_RULES, catalog_table.CATALOG_SCHEMA).write.parquet(path)
    table = catalog_table.read_catalog(spark.read.parquet(path))
    rows = catalog_table.with_table_matches(views.conversation_messages(spark, sf_dir), table, "text_raw")
    total = lambda value: F.aggregate(F.transform("matches", value), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return rows.select(
        "conv_id", "conv_idx", F.size("matches").alias("n_hits"), total(lambda m: m["rule_id"].cast("bigint")).alias("rule_sum"),
        total(lambda m: F.length(m["text"]).cast("bigint")).alias("n_chars"), rules.max_severity().alias("max_severity"),
        F.size(rules.categories()).alias("n_categories"))


@query(o.sql([*WIDE_CTES, *o.CHAT_HITS, *o.scored_ctes("all")],
             """SELECT conv_id, conv_idx, CAST(count(h.rule_id) AS INTEGER) AS n_hits, CAST(coalesce(max(severity), 0) AS INTEGER) AS max_severity,
             coalesce(string_agg(DISTINCT category, ',' ORDER BY category), '') AS categories
             FROM live LEFT JOIN hits h USING (conv_id, conv_idx) GROUP BY 1, 2"""))
def wide_catalog_summary(spark, sf_dir):
    rows = messages.annotate_messages(flagged_messages(spark, sf_dir), scope="all", catalog=WIDE)
    return text.drop_empty(rows).select(
        "conv_id", "conv_idx", "n_hits", "max_severity", joined(rules.mask_categories("cat_mask", WIDE)).alias("categories"))


@query(o.sql([*WIDE_CTES, *o.risk_ctes("all")], "SELECT conv_id, label, n_messages, base, cooccur, escal, arc, score, level, cats FROM risk"))
def wide_catalog_risk(spark, sf_dir):
    rows = messages.annotate_messages(flagged_messages(spark, sf_dir), scope="all", catalog=WIDE)
    risk = conversations.conversation_risk(rows, scope="all", catalog=WIDE)
    return risk.withColumn("cats", joined("categories")).select(
        "conv_id", "label", "n_messages", "base", "cooccur", "escal", "arc", "score", "level", "cats")


def wide_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages.annotate_contacts(views.contact_messages(views.read_table(spark, sf_dir, "events")), WIDE)
    return contacts.with_window(rows, WINDOW_KEYS, WINDOW_ORDER, catalog=WIDE)


@query(o.sql([*WIDE_CTES, *o.CONTACT], "SELECT contact_id, msg_id, base, cooccur, escal, arc, score, cats FROM win"))
def wide_window_risk(spark, sf_dir):
    return wide_windowed(spark, sf_dir).select(
        "contact_id", "msg_id", "base", "cooccur", "escal", "arc", "score",
        joined(rules.mask_categories("window_mask", WIDE), ", ").alias("cats"))


@query(o.sql([*o.CHAT_HITS, *o.scored_ctes("flagged")],
             """SELECT conv_id, conv_idx, string_agg(category || ':' || severity, ' ' ORDER BY r) AS tags FROM
             (SELECT conv_id, conv_idx, category, severity, min(rule_id) AS r FROM hits GROUP BY ALL) GROUP BY 1, 2"""))
def rule_tags(spark, sf_dir):
    tags = F.transform(rules.rule_tags(), lambda t: F.concat_ws(":", t["category"], t["severity"].cast("string")))
    rows = annotated(spark, sf_dir).select("conv_id", "conv_idx", F.explode_outer(F.array(F.array_join(tags, " "))).alias("tags"))
    return rows.filter("tags <> ''")


# --- conversation scores -------------------------------------------------------

SCORED = [*o.CHAT_HITS, *o.scored_ctes("flagged")]


@query(o.sql(SCORED, "SELECT * FROM catn"))
def category_message_counts(spark, sf_dir):
    return conversations.category_counts(annotated(spark, sf_dir))


@query(o.sql([*SCORED, o.WEIGHTS], "SELECT conv_id, category, msg_count, coalesce(weight, 1e0) AS weight FROM catn LEFT JOIN weights USING (category)"))
def weighted_category_counts(spark, sf_dir):
    counts = conversations.category_counts(annotated(spark, sf_dir))
    return conversations.weighted_counts(counts, DEFAULT.weights_df(spark))


@query(o.sql([*SCORED, o.PAIRS], """SELECT a.conv_id, cat_a, cat_b, bonus FROM pairs JOIN catn a ON a.category = cat_a
JOIN catn b ON b.category = cat_b AND a.conv_id = b.conv_id"""))
def active_pairs(spark, sf_dir):
    counts = conversations.category_counts(annotated(spark, sf_dir))
    return conversations.active_pairs(counts, DEFAULT.pairs_df(spark))


RISK = o.risk_ctes("flagged")


@query(o.sql(RISK, "SELECT conv_id, base, cooccur FROM risk"))
def base_scores(spark, sf_dir):
    return conversations.conversation_risk(annotated(spark, sf_dir)).select("conv_id", "base", "cooccur")


@query(o.sql(RISK, "SELECT conv_id, escal, arc FROM risk"))
def escalation_and_arc(spark, sf_dir):
    return conversations.conversation_risk(annotated(spark, sf_dir)).select("conv_id", "escal", "arc")


@query(o.sql(RISK, "SELECT conv_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs FROM risk LEFT JOIN runs USING (conv_id)"))
def consecutive_runs(spark, sf_dir):
    return conversations.message_runs(annotated(spark, sf_dir))


@query(o.sql(RISK, """SELECT conv_id, n_messages, n_flagged, CAST(total_hits AS BIGINT) AS total_hits, dominance, density,
round(n_flagged / nullif(n_messages, 0), 6) AS flagged_share, round(total_hits / nullif(n_flagged, 0), 6) AS hit_rate FROM risk"""))
def shares_and_density(spark, sf_dir):
    risk = conversations.conversation_risk(annotated(spark, sf_dir))
    return risk.select(
        "conv_id", "n_messages", "n_flagged", "total_hits", "dominance", "density",
        F.round(F.try_divide("n_flagged", "n_messages"), 6).alias("flagged_share"),
        F.round(F.try_divide("total_hits", "n_flagged"), 6).alias("hit_rate"))


RISK_SELECT = """SELECT conv_id, label, n_messages, n_flagged, CAST(total_hits AS BIGINT) AS total_hits, base, cooccur, escal, arc,
dominance, density, consec, score, level, cats FROM risk"""


def risk_table(spark: SparkSession, sf_dir: str, scope: str) -> DataFrame:
    risk = conversations.conversation_risk(annotated(spark, sf_dir, scope), scope=scope)
    return risk.withColumn("cats", joined("categories")).select(
        "conv_id", "label", "n_messages", "n_flagged", "total_hits", *conversations.COMPONENTS, "score", "level", "cats")


@query(o.sql(RISK, RISK_SELECT))
def conversation_risk(spark, sf_dir):
    return risk_table(spark, sf_dir, "flagged")


@query(o.sql(o.risk_ctes("all"), RISK_SELECT))
def conversation_risk_all_messages(spark, sf_dir):
    return risk_table(spark, sf_dir, "all")


# --- datasets -----------------------------------------------------------------

TEXTS = o.text_ctes("flagged")
SPLIT = [*TEXTS, o.SPLIT_EXACT]
HASHED = "CASE WHEN CAST('0x' || md5(conversation_id || '|42')[1:8] AS BIGINT) / 4294967296.0 < 0.1 THEN 'val' ELSE 'train' END AS split"


@query(o.sql(TEXTS, "SELECT conversation_id, label, text FROM dataset"))
def annotated_texts(spark, sf_dir):
    return datasets.whole_texts(dataset(spark, sf_dir)).select("conversation_id", "label", "text")


@query(o.sql(o.text_ctes("all"), "SELECT conversation_id, label, text FROM dataset"))
def annotated_texts_all_messages(spark, sf_dir):
    return datasets.whole_texts(dataset(spark, sf_dir, "all")).select("conversation_id", "label", "text")


@query(o.sql(SPLIT, "SELECT conversation_id, label, split, text FROM split"))
def dataset_exact_split(spark, sf_dir):
    return datasets.whole_texts(datasets.split_exact(dataset(spark, sf_dir))).select("conversation_id", "label", "split", "text")


@query(o.sql(o.CHAT, f"""SELECT conversation_id, label, {HASHED}
FROM (SELECT conv_id AS conversation_id, max(CAST(is_flagged AS INTEGER)) AS label FROM msg GROUP BY 1)"""))
def hash_split(spark, sf_dir):
    labels = messages.conversation_labels(flagged_messages(spark, sf_dir)).withColumnRenamed("conv_id", "conversation_id")
    return datasets.split_by_hash(labels).select("conversation_id", "label", "split")


LABELLED_SPLIT = """WITH dataset AS (SELECT doc_id AS conversation_id, toxic AS label FROM labels),
split AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(conversation_id || '|42'), CAST(conversation_id AS VARCHAR))
<= floor(count(*) OVER (PARTITION BY label) * 0.1 + 0.5) THEN 'val' ELSE 'train' END AS split FROM dataset) """


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conversation_id"), F.col("toxic").alias("label"))


@query(LABELLED_SPLIT + "SELECT * FROM split")
def labelled_split(spark, sf_dir):
    return datasets.split_exact(labelled(spark, sf_dir))


@query(LABELLED_SPLIT + """SELECT split, count(*) AS total, CAST(sum(label) AS BIGINT) AS pos, round(avg(label) * 100, 6) AS pos_pct,
CAST(sum(1 - label) AS BIGINT) AS neg FROM split GROUP BY 1""")
def split_statistics(spark, sf_dir):
    return datasets.split_statistics(datasets.split_exact(labelled(spark, sf_dir)))


@query("SELECT CAST(sum(toxic) AS BIGINT) AS pos, round(avg(toxic) * 100, 6) AS pos_pct FROM labels")
def positive_rate(spark, sf_dir):
    return datasets.positive_rate(labelled(spark, sf_dir))


@query(LABELLED_SPLIT + "SELECT * FROM split UNION ALL SELECT doc_id + 1000000000, quality, 'test' FROM labels")
def union_of_splits(spark, sf_dir):
    test = views.read_table(spark, sf_dir, "labels").select(
        (F.col("doc_id") + 1000000000).alias("conversation_id"), F.col("quality").alias("label"))
    return datasets.union_splits(datasets.split_exact(labelled(spark, sf_dir)), test)


# --- contact windows ------------------------------------------------------------

@query(o.sql(o.CONTACT, """SELECT contact_id, msg_id, CAST(window_len AS INTEGER) AS window_len, CAST(n_external AS INTEGER) AS n_external,
CAST(high_risk_count AS INTEGER) AS high_risk_count, CAST(risky_count AS INTEGER) AS risky_count FROM win"""))
def window_counts(spark, sf_dir):
    return windowed(spark, sf_dir).select("contact_id", "msg_id", "window_len", "n_external", "high_risk_count", "risky_count")


@query(o.sql(o.CONTACT, "SELECT contact_id, msg_id, category, CAST(k AS INTEGER) AS n FROM fc JOIN cm ON cm.msg_id = at_id"))
def window_category_counts(spark, sf_dir):
    scored = contacts.with_window(contact_annotated(spark, sf_dir), WINDOW_KEYS, WINDOW_ORDER, counts=True)
    rows = scored.select("contact_id", "msg_id", F.explode_outer("category_counts").alias("c"))
    return rows.filter("c IS NOT NULL").select("contact_id", "msg_id", "c.category", "c.n")


@query(o.sql(o.CONTACT, "SELECT contact_id, msg_id, base, cooccur, escal, arc, consec, score FROM win"))
def window_risk(spark, sf_dir):
    return windowed(spark, sf_dir).select("contact_id", "msg_id", "base", "cooccur", "escal", "arc", "consec", "score")


STATS_SELECT = """SELECT contact_id, msg_id, CAST(window_len AS INTEGER) AS window_len, CAST(high_risk_count AS INTEGER) AS high_risk_count,
CAST(risky_count AS INTEGER) AS risky_count, round(score, 2) AS score, cats, escal > 0 AS escal, arc > 0 AS arc FROM win"""


@query(o.sql(o.CONTACT, STATS_SELECT))
def window_stats(spark, sf_dir):
    stats = contacts.window_stats(windowed(spark, sf_dir), ["contact_id", "msg_id"])
    return stats.withColumn("cats", joined("cats", ", "))


@query(o.sql(o.contact_ctes("contact_id, day", ", CAST(ts AS DATE) AS day"),
             "SELECT contact_id, msg_id, CAST(window_len AS INTEGER) AS window_len, escal, arc, consec, score FROM win"))
def window_reset_daily(spark, sf_dir):
    daily = contact_annotated(spark, sf_dir).withColumn("day", F.to_date("ts"))
    scored = contacts.with_window(daily, ["contact_id", "day"], WINDOW_ORDER)
    return scored.select("contact_id", "msg_id", "window_len", "escal", "arc", "consec", "score")


ALERT_SELECT = "SELECT contact_id, msg_id, level, reason, score, escal > 0 AS escal, arc > 0 AS arc FROM al"


@query(o.sql(o.CONTACT, ALERT_SELECT))
def contact_alerts(spark, sf_dir):
    raised = contacts.alerts(windowed(spark, sf_dir))
    return raised.select("contact_id", "msg_id", "level", "reason", "score", (F.col("escal") > 0).alias("escal"), (F.col("arc") > 0).alias("arc"))


@query(o.sql(o.CONTACT, "SELECT contact_id, level, count(*) AS n_alerts, max(score) AS top_score FROM al GROUP BY 1, 2"))
def alerts_per_contact(spark, sf_dir):
    raised = contacts.alerts(windowed(spark, sf_dir))
    return raised.groupBy("contact_id", "level").agg(F.count(F.lit(1)).alias("n_alerts"), F.max("score").alias("top_score"))


@query(o.sql([*o.CONTACT, """rl AS (SELECT text, string_agg('  rule     : [' || category || ' sev=' || severity || '] ''' || hit || '''', chr(10) ORDER BY rule_id) AS rl FROM th GROUP BY 1)"""],
             """SELECT contact_id, msg_id, '[' || upper(level) || '] ' || reason || chr(10) || '  message  : ''' || substr(text, 1, 120) || '''' || chr(10)
             || '  ml_prob  : ' || printf('%.3f', p) || chr(10) || '  score    : ' || printf('%.2f', score)
             || CASE WHEN escal > 0 OR arc > 0 THEN chr(10) || '  signals  : ' || concat_ws('  ', CASE WHEN escal > 0 THEN 'ESC=yes' END, CASE WHEN arc > 0 THEN 'ARC=yes' END) ELSE '' END
             || coalesce(chr(10) || rl, '') AS rendered FROM al LEFT JOIN rl USING (text)"""))
def alert_rendering(spark, sf_dir):
    return contacts.alerts(windowed(spark, sf_dir)).select("contact_id", "msg_id", contacts.render_alert().alias("rendered"))


# --- parsed records, reports ---------------------------------------------------

REC = o.RECORDS
REC_COLUMNS = """conversation_id, label, label_str, risk_level, risk_order, escalation, arc, dominance, categories, n_categories,
total_rule_hits, sev3_hits, n_messages"""


@query(o.sql(REC, f"SELECT {REC_COLUMNS} FROM rec"))
def parsed_records(spark, sf_dir):
    return slim(spark, sf_dir).withColumn("categories", joined("categories")).drop("cat_counts")


@query(o.sql(REC, """SELECT conv_id AS conversation_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY conv_idx) - 1 AS INTEGER) AS pos,
CASE WHEN is_flagged THEN 'PRED' ELSE 'USER' END AS role, norm AS text, coalesce(tl, '') AS rules FROM live LEFT JOIN
(SELECT conv_id, conv_idx, string_agg(category || ':' || severity, ' ' ORDER BY r) AS tl FROM tag1 GROUP BY 1, 2) USING (conv_id, conv_idx)"""))
def parsed_messages(spark, sf_dir):
    rows = records.parse_records(dataset(spark, sf_dir)).select("conversation_id", F.posexplode("messages").alias("pos", "m"))
    tags = F.transform("m.rules", lambda r: F.concat_ws(":", r["category"], r["severity"].cast("string")))
    return rows.select("conversation_id", "pos", "m.role", "m.text", F.array_join(tags, " ").alias("rules"))


@query(o.sql(REC, "SELECT conv_id AS conversation_id, category, CAST(n AS INTEGER) AS tag_count FROM tagn"))
def record_category_counts(spark, sf_dir):
    return slim(spark, sf_dir).select("conversation_id", F.explode("cat_counts").alias("category", "tag_count"))


@query(o.sql(REC, """SELECT conv_id AS conversation_id, string_agg(category || ':' || n, '  ' ORDER BY n DESC, firstpos) AS by_count FROM tagn GROUP BY 1"""))
def record_category_order(spark, sf_dir):
    entries = F.transform(reports.categories_by_count(), lambda e: F.concat_ws(":", e["category"], e["n"].cast("string")))
    rows = slim(spark, sf_dir).filter(F.size("cat_counts") > 0)
    return rows.select("conversation_id", F.array_join(entries, "  ").alias("by_count"))


RANK = "row_number() OVER (ORDER BY risk_order DESC, sev3_hits DESC, total_rule_hits DESC, conversation_id) AS idx"


@query(o.sql(REC, f"SELECT {RANK}, conversation_id, risk_level, sev3_hits, total_rule_hits FROM rec"))
def ranked_report(spark, sf_dir):
    return reports.ranked_report(slim(spark, sf_dir)).select("idx", "conversation_id", "risk_level", "sev3_hits", "total_rule_hits")


@query("""SELECT row_number() OVER (ORDER BY quality DESC, toxic DESC, doc_id % 7 DESC, doc_id) AS idx, doc_id AS conversation_id, quality, toxic
FROM (SELECT * FROM (SELECT *, row_number() OVER () AS place FROM labels) WHERE place <= 120)""")
def first_of_file_report(spark, sf_dir):
    """The first rows of the file, ranked."""
    rows = reports.with_file_order(views.read_table(spark, sf_dir, "labels")).select(
        F.col("doc_id").alias("conversation_id"), "quality", "toxic", F.col("quality").alias("risk_order"),
        F.col("toxic").alias("sev3_hits"), (F.col("doc_id") % 7).alias("total_rule_hits"), *reports.FILE_ORDER)
    return reports.ranked_report(rows, limit=120, first_by=reports.FILE_ORDER).select("idx", "conversation_id", "quality", "toxic")


@query(o.sql(REC, f"SELECT {RANK}, conversation_id, label_str, risk_level, sev3_hits FROM rec WHERE label = 1"))
def positives_report(spark, sf_dir):
    return reports.ranked_report(slim(spark, sf_dir), only_positive=True).select("idx", "conversation_id", "label_str", "risk_level", "sev3_hits")


@query(o.sql(REC, f"SELECT {RANK}, conversation_id, risk_level FROM (SELECT * FROM rec ORDER BY conversation_id LIMIT 50)"))
def limited_report(spark, sf_dir):
    return reports.ranked_report(slim(spark, sf_dir), limit=50).select("idx", "conversation_id", "risk_level")


@query(o.sql(REC, """SELECT conversation_id, risk_level, sev3_hits, total_rule_hits FROM rec
ORDER BY risk_order DESC, sev3_hits DESC, total_rule_hits DESC, conversation_id LIMIT 25"""))
def top_report(spark, sf_dir):
    return reports.top_report(slim(spark, sf_dir), 25).select("conversation_id", "risk_level", "sev3_hits", "total_rule_hits")


@query(o.sql([*REC, """line AS (SELECT conv_id, string_agg(CASE WHEN is_flagged THEN '[PRED]' ELSE '[USER]' END || coalesce('  ' || tl, '') || '  ' || norm, chr(10) ORDER BY conv_idx) AS ls
FROM live LEFT JOIN (SELECT conv_id, conv_idx, string_agg('[' || category || ':' || severity || ']', ' ' ORDER BY r) AS tl FROM tag1 GROUP BY 1, 2) USING (conv_id, conv_idx) GROUP BY 1)""",
              "cnt AS (SELECT conv_id, string_agg(category || ':' || n, '  ' ORDER BY n DESC, firstpos) AS cs FROM tagn GROUP BY 1)"],
             f"""SELECT conversation_id, repeat('=', 70) || chr(10) || '#' || idx || '  [' || label_str || ']  RISK:' || risk_level
             || CASE WHEN escalation THEN '  ESC' ELSE '' END || CASE WHEN arc THEN '  ARC' ELSE '' END || CASE WHEN dominance THEN '  DOM' ELSE '' END
             || chr(10) || 'id=' || conversation_id || CASE WHEN categories <> '' THEN chr(10) || 'cats=' || replace(categories, ',', ', ') ELSE '' END
             || coalesce(chr(10) || 'rules=' || cs, '') || chr(10) || repeat('-', 70) || coalesce(chr(10) || ls, '') || chr(10) AS readable
             FROM (SELECT *, {RANK} FROM rec) r LEFT JOIN line ON line.conv_id = conversation_id LEFT JOIN cnt ON cnt.conv_id = conversation_id"""))
def readable_report(spark, sf_dir):
    ranked = reports.ranked_report(records.parse_records(dataset(spark, sf_dir)))
    return ranked.select("conversation_id", reports.readable_text().alias("readable"))


@query(o.sql(REC, """SELECT label, count(*) FILTER (risk_level = 'HIGH') AS "HIGH", count(*) FILTER (risk_level = 'MEDIUM') AS "MEDIUM",
count(*) FILTER (risk_level = 'LOW') AS "LOW", count(*) FILTER (risk_level = 'UNKNOWN') AS "UNKNOWN" FROM rec GROUP BY 1"""))
def level_counts(spark, sf_dir):
    return reports.level_counts(slim(spark, sf_dir))


@query(o.sql(REC, """SELECT label, round(100 * avg(CAST(escalation AS INTEGER)), 6) AS escalation, round(100 * avg(CAST(arc AS INTEGER)), 6) AS arc,
round(100 * avg(CAST(dominance AS INTEGER)), 6) AS dominance FROM rec GROUP BY 1"""))
def flag_rates(spark, sf_dir):
    return reports.flag_rates(slim(spark, sf_dir))


TOTALS = "SELECT category, CAST(sum(n) AS BIGINT) AS hits FROM tagn JOIN rec ON conversation_id = conv_id WHERE label = 1 GROUP BY 1"


@query(o.sql(REC, TOTALS))
def category_totals(spark, sf_dir):
    return reports.category_totals(slim(spark, sf_dir))


@query(o.sql(REC, TOTALS + " ORDER BY hits DESC, category LIMIT 5"))
def top_categories(spark, sf_dir):
    return reports.top_categories(slim(spark, sf_dir), 5)


@query(o.sql(REC, """SELECT l.label, CAST(b.bin AS INTEGER) AS bin, count(rec.label) AS n FROM (VALUES (0), (1)) l(label), (SELECT unnest(range((SELECT max(n_categories) + 1 FROM rec))) AS bin) b
LEFT JOIN rec ON rec.label = l.label AND n_categories = b.bin GROUP BY 1, 2"""))
def category_histogram(spark, sf_dir):
    return reports.category_histogram(slim(spark, sf_dir))


@query(o.sql([*REC, "e AS (SELECT least(greatest(max(sev3_hits), 1) + 2, 20) - 1 AS edge FROM rec)", "b AS (SELECT unnest(range((SELECT edge FROM e))) AS bin)"],
             """SELECT l.label, CAST(b.bin AS INTEGER) AS bin, count(rec.label) AS n FROM (VALUES (0), (1)) l(label), b LEFT JOIN rec ON rec.label = l.label
             AND (sev3_hits = b.bin OR (b.bin = (SELECT edge - 1 FROM e) AND sev3_hits = b.bin + 1)) GROUP BY 1, 2"""))
def severity_histogram(spark, sf_dir):
    return reports.severity_histogram(slim(spark, sf_dir))


@query(o.sql([*REC, "e AS (SELECT greatest(max(total_rule_hits), 1) + 1 AS top, least(40, greatest(max(total_rule_hits), 1) + 2) - 1 AS bins FROM rec)",
              "b AS (SELECT unnest(range((SELECT bins FROM e))) AS bin)"],
             """SELECT l.label, CAST(b.bin AS INTEGER) AS bin, round(b.bin * e.top / e.bins, 6) AS low, count(rec.label) AS n FROM (VALUES (0), (1)) l(label), b, e LEFT JOIN rec ON rec.label = l.label
             AND total_rule_hits * e.bins >= b.bin * e.top AND total_rule_hits * e.bins < (b.bin + 1) * e.top GROUP BY 1, 2, 3"""))
def hits_histogram(spark, sf_dir):
    return reports.hits_histogram(slim(spark, sf_dir))


@query(o.sql(REC, """SELECT label, count(*) AS total, count(*) FILTER (risk_level = 'HIGH') AS "HIGH", count(*) FILTER (risk_level = 'MEDIUM') AS "MEDIUM",
count(*) FILTER (risk_level = 'LOW') AS "LOW" FROM rec GROUP BY 1"""))
def split_summary(spark, sf_dir):
    return reports.split_summary(slim(spark, sf_dir))


# --- evaluation -----------------------------------------------------------------

ROWS = "WITH " + o.SCORED_ROWS + " "
METRIC = """, c AS (SELECT count(*) FILTER (prob >= 0.5 AND label = 1) AS tp, count(*) FILTER (prob >= 0.5 AND label = 0) AS fp,
count(*) FILTER (prob < 0.5 AND label = 1) AS fn FROM sr),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM c) """


@query(ROWS + METRIC + "SELECT tp, fp, fn FROM c")
def confusion_counts(spark, sf_dir):
    return evaluation.confusion(scored_rows(spark, sf_dir))


@query(ROWS + METRIC + """SELECT tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall,
round(CASE WHEN 4 * precision + recall = 0 THEN 0.0 ELSE 5 * precision * recall / (4 * precision + recall) END, 6) AS f2, 0.5e0 AS threshold FROM pr""")
def metrics_at_threshold(spark, sf_dir):
    result = evaluation.metrics(scored_rows(spark, sf_dir), 0.5)
    return result.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f2")})


@query(o.sql(o.GRID_METRICS, """SELECT round(threshold, 6) AS threshold, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall,
round(f2, 6) AS f2 FROM gf"""))
def threshold_table(spark, sf_dir):
    table = evaluation.threshold_table(scored_rows(spark, sf_dir))
    return table.withColumns({c: F.round(c, 6) for c in ("threshold", "precision", "recall", "f2")})


@query(o.sql(o.GRID_METRICS, """SELECT round(CASE WHEN max(f2) > 0 THEN arg_max(threshold, (round(f2, 12), -threshold)) ELSE 0.5 END, 6) AS threshold, round(max(f2), 6) AS f2 FROM gf"""))
def calibrated_threshold(spark, sf_dir):
    return evaluation.calibrate(scored_rows(spark, sf_dir)).select(F.round("threshold", 6).alias("threshold"), F.round("f2", 6).alias("f2"))


@query("""WITH sr AS (SELECT doc_id AS id, 1 / (1 + exp(-((n_chars % 1000) - 500) / 100.0)) AS prob, toxic AS label FROM labels JOIN documents USING (doc_id)),
c AS (SELECT count(*) FILTER (prob >= 0.35 AND label = 1) AS tp, count(*) FILTER (prob >= 0.35 AND label = 0) AS fp, count(*) FILTER (prob < 0.35 AND label = 1) AS fn FROM sr),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM c)
SELECT tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall,
round(CASE WHEN 4 * precision + recall = 0 THEN 0.0 ELSE 5 * precision * recall / (4 * precision + recall) END, 6) AS f2, 0.35e0 AS threshold FROM pr""")
def evaluated_logits(spark, sf_dir):
    logits = views.read_table(spark, sf_dir, "documents").select("doc_id", ((F.col("n_chars") % 1000 - 500) / 100.0).alias("logit"))
    scores = logits.select(F.col("doc_id").alias("id"), evaluation.sigmoid(F.col("logit")).alias("prob"))
    labels = views.read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    result = evaluation.evaluate(labels, scores, "id", 0.35)
    return result.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f2")})


@query("SELECT event_id, round(1 / (1 + exp(-(value - 50) / 20.0)), 6) AS prob FROM events")
def sigmoid_of_logit(spark, sf_dir):
    events = views.read_table(spark, sf_dir, "events")
    return events.select("event_id", F.round(evaluation.sigmoid((F.col("value") - 50) / 20.0), 6).alias("prob"))


@query("""WITH c AS (SELECT sum(toxic) AS n_pos, count(*) - sum(toxic) AS n_neg FROM labels), s(label, scale) AS (VALUES (0, 0.0), (1, 3.0))
SELECT label, CASE WHEN label = 0 THEN 1.0 ELSE round(scale * (n_neg / n_pos), 6) END AS weight, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg FROM c, s""")
def class_weights(spark, sf_dir):
    weights = evaluation.class_weights(labelled(spark, sf_dir), 3.0)
    return weights.withColumn("weight", F.round("weight", 6))


@query("""WITH c AS (SELECT sum(toxic) AS n_pos, count(*) - sum(toxic) AS n_neg FROM labels)
SELECT doc_id AS conversation_id, toxic AS label, round(CASE WHEN toxic = 1 THEN 2.0 * (n_neg / n_pos) ELSE 1.0 END, 6) AS weight FROM labels, c""")
def weighted_rows(spark, sf_dir):
    rows = evaluation.with_class_weight(labelled(spark, sf_dir), 2.0)
    return rows.select("conversation_id", "label", F.round("weight", 6).alias("weight"))


EPOCH_LOG = """WITH RECURSIVE g AS (SELECT user_id AS run_id, event_id AS epoch, floor(value / 10) / 100.0 AS f2 FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS k FROM g),
f AS (SELECT run_id, epoch, f2, k, f2 > 0 AS is_best, CASE WHEN f2 > 0 THEN f2 ELSE 0.0 END AS best, CASE WHEN f2 > 0 THEN 0 ELSE 1 END AS bad,
 CASE WHEN f2 > 0 THEN epoch END AS best_epoch FROM r WHERE k = 1
UNION ALL SELECT r.run_id, r.epoch, r.f2, r.k, r.f2 > f.best, greatest(r.f2, f.best), CASE WHEN r.f2 > f.best THEN 0 ELSE f.bad + 1 END,
 CASE WHEN r.f2 > f.best THEN r.epoch ELSE f.best_epoch END FROM f JOIN r ON r.run_id = f.run_id AND r.k = f.k + 1 WHERE f.bad < 3) """


@query(EPOCH_LOG + "SELECT run_id, max(epoch) AS last_epoch, max(best_epoch) AS best_epoch, max(best) AS best_f2 FROM f GROUP BY 1")
def best_epochs(spark, sf_dir):
    log = views.read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("epoch"), (F.floor(F.col("value") / 10) / 100.0).alias("f2"))
    return evaluation.best_epoch(log, ["run_id"], patience=3)


@query()
def classifier_metrics(spark, sf_dir):
    """Fit on train, choose on val, report on test: documents labelled for quality."""
    rows = views.read_table(spark, sf_dir, "documents").join(views.read_table(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id", "text", F.col("quality").alias("label"))
    held = datasets.split_by_hash(rows, "doc_id", 0.2, 7)
    test = held.filter("split = 'val'").drop("split")
    fit = datasets.split_by_hash(held.filter("split = 'train'").drop("split"), "doc_id", 0.2, 8)
    model, threshold, _ = classifier.fit_classifier(
        fit.filter("split = 'train'"), fit.filter("split = 'val'"))
    return classifier.evaluate_classifier(model, test, threshold)


PARTS = """WITH held AS (SELECT doc_id, quality, CAST('0x' || md5(doc_id || '|7')[1:8] AS BIGINT) / 4294967296.0 < 0.2 AS is_test,
CAST('0x' || md5(doc_id || '|8')[1:8] AS BIGINT) / 4294967296.0 < 0.2 AS is_val FROM documents JOIN labels USING (doc_id))"""


@query(PARTS + """SELECT count(*) FILTER (NOT is_test AND NOT is_val) AS n_train, count(*) FILTER (NOT is_test AND is_val) AS n_val,
count(*) FILTER (is_test) AS n_test, count(*) FILTER (is_test AND quality = 1) AS n_positive, true AS loss_fell, true AS stopped_as_logged,
true AS counts_add_up FROM held""")
def trained_epochs(spark, sf_dir):
    """A fit in epochs with early stop: documents labelled for quality. What the SQL knows of it are its counts, and that
    the loss falls, the run ends where the log says, and the counts at the threshold add up to the test's positives."""
    rows = views.read_table(spark, sf_dir, "documents").join(views.read_table(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id", "text", F.col("quality").alias("label"))
    held = datasets.split_by_hash(rows, "doc_id", 0.2, 7)
    test = held.filter("split = 'val'").drop("split")
    fit = datasets.split_by_hash(held.filter("split = 'train'").drop("split"), "doc_id", 0.2, 8)
    train, val = (fit.filter(F.col("split") == s).drop("split") for s in ("train", "val"))
    model, log = trainer.train_epochs(train, val, epochs=6, patience=2)
    ran = evaluation.epoch_choice(log, ["run"], 2)
    loss_fell = F.min_by("loss", -F.col("epoch")) < F.min_by("loss", "epoch")
    logged = ran.agg(loss_fell.alias("loss_fell"), (F.every("ran") & ((F.max("no_improve") >= 2) | (F.count(F.lit(1)) == 6))).alias("stopped_as_logged"))
    scored = model.score(test).select("prob", "label")
    counts, run = evaluation.metrics(scored, model.threshold).first(), logged.first()
    sizes = test.agg(F.count(F.lit(1)).alias("n_test"), F.count_if(F.col("label") == 1).alias("n_positive"))
    return sizes.withColumns({
        "n_train": F.lit(train.count()).cast("bigint"), "n_val": F.lit(val.count()).cast("bigint"),
        "loss_fell": F.lit(run.loss_fell), "stopped_as_logged": F.lit(run.stopped_as_logged),
        "counts_add_up": F.col("n_positive") == counts.tp + counts.fn})


@query("SELECT doc_id, round(least(length(text) / 1000.0, 1.0), 6) AS prob FROM documents")
def user_model_scores(spark, sf_dir):
    def load():
        return lambda texts: (texts.str.len() / 1000.0).clip(upper=1.0)

    docs = views.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return classifier.score_with(load, docs, model_key="length").select("doc_id", F.round("prob", 6).alias("prob"))


@query("""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')[1:256] AS words FROM documents)
SELECT doc_id, CAST(len(words) AS INTEGER) AS n_tokens,
array_to_string(list_concat(list_transform(words, lambda w: CAST('0x' || md5(w)[1:8] AS BIGINT) % 1048575 + 1), list_transform(range(256 - len(words)), lambda i: 0::BIGINT)), ',') AS ids,
array_to_string(list_concat(list_transform(words, lambda w: 1), list_transform(range(256 - len(words)), lambda i: 0)), '') AS mask,
repeat('0', 256) AS types FROM w""")
def token_sequences(spark, sf_dir):
    docs = views.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = classifier.token_sequences(docs, length=256)
    return rows.select(
        "doc_id", "n_tokens", F.array_join("input_ids", ",").alias("ids"), F.array_join("attention_mask", "").alias("mask"),
        F.array_join("token_type_ids", "").alias("types"))


# --- files: written by Spark from the tables, read back by the sources ----------

@query(o.sql(o.CHAT, "SELECT CAST(conv_id AS VARCHAR) AS conv_id, conv_idx, author, trim(text_raw) AS text_raw FROM msg"))
def xml_messages(spark, sf_dir):
    rows = views.conversation_messages(spark, sf_dir).withColumn("id", F.col("conv_id").cast("string"))
    return corpus.read_messages(spark, written_xml(rows.withColumnRenamed("conv_id", "conv"), scratch_path(spark, "corpus-xml")))


def written_xml(rows: DataFrame, path: str) -> str:
    """Messages (conv, id, conv_idx, author, text_raw) as XML files, a message per line; ids may repeat or be missing."""
    def escaped(column: str) -> Column:
        whole = F.col(column)
        for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            whole = F.replace(whole, F.lit(sign), F.lit(name))
        return whole

    last = F.lead("conv_idx").over(Window.partitionBy("conv").orderBy("conv_idx")).isNull()
    attribute = F.when(F.col("id").isNull(), "").otherwise(F.concat(F.lit(' id="'), escaped("id"), F.lit('"')))
    line = F.concat(
        F.when(F.col("conv_idx") == 0, F.concat(F.lit("<conversation"), attribute, F.lit(">"))).otherwise(""),
        F.lit("<message><author>"), escaped("author"), F.lit("</author><text>"), escaped("text_raw"), F.lit("</text></message>"),
        F.when(last, "</conversation>").otherwise(""))

    def rooted(batches):
        columns = itertools.chain([pa.array(["<conversations>"])], (b.column("value") for b in batches), [pa.array(["</conversations>"])])
        yield from (pa.RecordBatch.from_arrays([column], names=["value"]) for column in columns)

    lines = rows.select("conv", "conv_idx", line.alias("value")).repartition("conv").sortWithinPartitions("conv", "conv_idx")
    lines.select("value").mapInArrow(rooted, "value STRING").write.text(path)
    return path


@query(o.sql(o.CHAT, """SELECT CASE WHEN conv_id % 7 <> 0 THEN CAST(conv_id // 2 AS VARCHAR) ELSE '' END AS conv_id, conv_idx, author, trim(text_raw) AS text_raw,
count(*) OVER (PARTITION BY conv_id) AS n_messages FROM msg"""))
def xml_conversations(spark, sf_dir):
    """Ids that two elements share, and elements without one: each element stays a conversation of its own."""
    rows = views.conversation_messages(spark, sf_dir).withColumn("id", F.when(
        F.col("conv_id") % 7 != 0, F.floor(F.col("conv_id") / 2).cast("string"))).withColumnRenamed("conv_id", "conv")
    found = corpus.read_elements(spark, written_xml(rows, scratch_path(spark, "elements-xml")))
    sizes = found.groupBy("conv_key").agg(F.count(F.lit(1)).alias("n_messages"))
    return found.join(sizes, "conv_key").drop("conv_key")


@query(o.sql(o.CHAT, "SELECT DISTINCT author AS author_id FROM msg WHERE is_flagged"))
def author_list(spark, sf_dir):
    path = scratch_path(spark, "authors")
    lines = views.flagged_authors(spark, sf_dir).select(F.concat(F.lit("  "), "author_id", F.lit(" ")).alias("value"))
    comments = lines.select(F.concat(F.lit("# "), "value").alias("value"))
    lines.unionByName(comments).write.text(path)
    return corpus.read_authors(spark, path)


@query(o.sql(o.CHAT, "SELECT DISTINCT CAST(conv_id AS VARCHAR) AS conv_id, author AS author_id FROM msg WHERE is_flagged"))
def ground_truth(spark, sf_dir):
    path = scratch_path(spark, "truth")
    pairs = views.flagged_pairs(spark, sf_dir)
    tabbed = F.concat_ws("\t", "conv_id", "author_id", F.lit("extra"))
    spaced = F.concat_ws("  ", "conv_id", "author_id")
    pairs.select(F.explode(F.array(tabbed, spaced, F.col("conv_id").cast("string"))).alias("value")).write.text(path)
    return corpus.read_truth(spark, path)


@query(o.sql(TEXTS, "SELECT CAST(conversation_id AS VARCHAR) AS conversation_id, text, label FROM dataset"))
def dataset_json(spark, sf_dir):
    path = scratch_path(spark, "dataset-json")
    datasets.split_by_hash(dataset(spark, sf_dir)).write.json(path)
    return corpus.read_records(spark, path, lines=True)


@query(o.sql(TEXTS, f"SELECT CAST(conversation_id AS VARCHAR) AS conversation_id, text, label, {HASHED} FROM dataset"))
def dataset_json_array(spark, sf_dir):
    """Datasets as JSON arrays, a folder per split."""
    path = scratch_path(spark, "dataset-array")
    sinks.write_json_array(datasets.split_by_hash(dataset(spark, sf_dir)), path)
    rows = [datasets.whole_texts(corpus.read_array_records(spark, f"{path}/split={s}")).withColumn("split", F.lit(s)) for s in ("train", "val")]
    return rows[0].unionByName(rows[1]).select("conversation_id", "text", "label", "split")


@query(o.sql(SPLIT, "SELECT conversation_id, text, label, split FROM split"))
def dataset_sink(spark, sf_dir):
    path = scratch_path(spark, "dataset")
    sinks.write_dataset(datasets.split_exact(dataset(spark, sf_dir)), path)
    return datasets.whole_texts(spark.read.parquet(path)).select("conversation_id", "text", "label", "split")


@query(o.sql([*REC, "cc AS (SELECT conv_id, string_agg(category || ':' || n, ',' ORDER BY category) AS cat_counts FROM tagn GROUP BY 1)"],
             f"SELECT {RANK}, {REC_COLUMNS}, coalesce(cat_counts, '') AS cat_counts FROM rec LEFT JOIN cc ON conv_id = conversation_id"))
def analysis_sink(spark, sf_dir):
    path = scratch_path(spark, "analysis")
    sinks.write_analysis(reports.ranked_report(slim(spark, sf_dir)), path)
    schema = """idx BIGINT, conversation_id BIGINT, label INT, label_str STRING, risk_level STRING, risk_order INT, escalation BOOLEAN, arc BOOLEAN,
    dominance BOOLEAN, categories ARRAY<STRING>, n_categories INT, total_rule_hits INT, sev3_hits INT, n_messages INT, cat_counts MAP<STRING, INT>"""
    counts = F.transform(F.map_entries("cat_counts"), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return spark.read.schema(schema).json(path).withColumns({
        "categories": joined("categories"), "cat_counts": F.array_join(F.array_sort(counts), ",")})


@query(o.sql([*REC, """line AS (SELECT conv_id, CASE WHEN is_flagged THEN '[PRED]' ELSE '[USER]' END || coalesce('  ' || tl, '') || '  ' || norm AS value
FROM live LEFT JOIN (SELECT conv_id, conv_idx, string_agg('[' || category || ':' || severity || ']', ' ' ORDER BY r) AS tl FROM tag1 GROUP BY 1, 2) USING (conv_id, conv_idx))""",
              f"rk AS (SELECT {RANK}, * FROM rec)",
              "ru AS (SELECT conv_id, string_agg(category || ':' || n, '  ' ORDER BY n DESC, firstpos) AS by_count FROM tagn GROUP BY 1)"],
             """SELECT value, count(*) AS n FROM (SELECT value FROM line UNION ALL SELECT repeat('=', 70) FROM rk UNION ALL SELECT repeat('-', 70) FROM rk
             UNION ALL SELECT '' FROM rk UNION ALL SELECT 'id=' || conversation_id FROM rk
             UNION ALL SELECT 'cats=' || replace(categories, ',', ', ') FROM rk WHERE categories <> ''
             UNION ALL SELECT 'rules=' || by_count FROM ru
             UNION ALL SELECT '#' || idx || '  [' || label_str || ']  RISK:' || risk_level || CASE WHEN escalation THEN '  ESC' ELSE '' END
             || CASE WHEN arc THEN '  ARC' ELSE '' END || CASE WHEN dominance THEN '  DOM' ELSE '' END FROM rk) GROUP BY 1"""))
def readable_sink(spark, sf_dir):
    path = scratch_path(spark, "readable")
    rows = checkpointed(dataset(spark, sf_dir), "dataset")
    ranked = reports.ranked_report(records.slim_records(rows))
    sinks.write_readable_lines(reports.readable_lines(ranked, records.parsed_parts(rows)), path)
    return spark.read.text(path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query(ORACLE["metrics_at_threshold"])
def metrics_sink(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    sinks.write_metrics(metrics_at_threshold(spark, sf_dir), path)
    return spark.read.schema("tp BIGINT, fp BIGINT, fn BIGINT, precision DOUBLE, recall DOUBLE, f2 DOUBLE, threshold DOUBLE").json(path)


# --- streams -----------------------------------------------------------------------

def feed(spark: SparkSession, sf_dir: str, reset=None) -> DataFrame:
    """The events as a stream of contact messages."""
    streams.prepare_session(spark)
    schema = views.read_table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    messages_ = views.contact_messages(source.withColumn("ts", F.col("ts").cast("timestamp")))
    return messages_.withColumn("reset", F.lit(False) if reset is None else reset)


def drained(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over all that is there and read its sink."""
    path = scratch_path(spark, label)
    sinks.write_alerts(stream, f"{path}/rows", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/rows")


@query(ORACLE["contact_alerts"])
def alert_stream(spark, sf_dir):
    rows = drained(spark, streams.alert_stream(feed(spark, sf_dir)).drop("matches"), "alert-stream")
    return rows.select("contact_id", "msg_id", "level", "reason", "score", (F.col("escal") > 0).alias("escal"), (F.col("arc") > 0).alias("arc"))


@query(ORACLE["window_stats"])
def stats_stream(spark, sf_dir):
    rows = drained(spark, streams.stats_stream(feed(spark, sf_dir)), "stats-stream")
    return rows.withColumn("cats", joined("cats", ", ")).drop("ts")


ALERTS_AND_STATS = """SELECT contact_id, msg_id, level, CAST(NULL AS INTEGER) AS window_len, score FROM al
UNION ALL SELECT contact_id, msg_id, 'stats', CAST(window_len AS INTEGER), round(score, 2) FROM win"""


def redelivered_feed(spark: SparkSession, sf_dir: str, path: str) -> str:
    """The messages as files of a feed in three slices of time; a contact's messages of a slice are in one file. Every
    third message comes a second time, in the last files."""
    rows = views.contact_messages(views.read_table(spark, sf_dir, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withColumn("reset", F.lit(False)).select("contact_id", "ts", "msg_id", "sender", "text", "ml_prob", "reset")
    span = rows.agg(F.min("ts").cast("double").alias("low"), F.max("ts").cast("double").alias("high")).first()
    share = (F.col("ts").cast("double") - span.low) / max(span.high - span.low, 1.0)
    for part in [F.least(F.floor(share * 3), F.lit(2)) == k for k in range(3)] + [F.col("msg_id") % 3 == 0]:
        rows.filter(part).repartition(2, "contact_id").write.mode("append").parquet(path)  # files are read in order of time written
    return path


@query(o.sql(o.CONTACT, ALERTS_AND_STATS))
def alerts_and_stats(spark, sf_dir):
    """One state for both tables, over a feed in several micro-batches that delivers messages again."""
    streams.prepare_session(spark)
    path = scratch_path(spark, "alerts-and-stats")
    incoming = corpus.read_feed(spark, redelivered_feed(spark, sf_dir, f"{path}/feed"), files_per_batch=1, redelivered=True)
    sinks.write_alerts_and_stats(streams.stream_windows(incoming), f"{path}/alerts", f"{path}/stats", f"{path}/state").awaitTermination()
    raised = spark.read.parquet(f"{path}/alerts").select("contact_id", "msg_id", "level", F.lit(None).cast("int").alias("window_len"), "score")
    stats = spark.read.parquet(f"{path}/stats")
    return raised.unionByName(stats.select("contact_id", "msg_id", F.lit("stats").alias("level"), "window_len", "score"))


@query(o.sql([*WIDE_CTES, *o.CONTACT], "SELECT contact_id, msg_id, score, cats FROM win"))
def wide_catalog_stream(spark, sf_dir):
    scored = streams.stream_windows(feed(spark, sf_dir), catalog=WIDE)
    return drained(spark, scored.select("contact_id", "msg_id", "score", joined(rules.mask_categories("window_mask", WIDE), ", ").alias("cats")), "wide-stream")


@query(o.sql(o.CONTACT, """SELECT msg_id, CAST(coalesce(max_severity, 0) AS INTEGER) AS max_severity, CASE WHEN ext THEN coalesce(mc, '') ELSE '' END AS cats FROM
(SELECT cm.msg_id, cm.ext, CASE WHEN cm.ext THEN tsev.sev END AS max_severity, mc FROM cm LEFT JOIN tsev USING (text) LEFT JOIN mcats USING (text))"""))
def annotated_stream(spark, sf_dir):
    stream = streams.annotate_stream(feed(spark, sf_dir)).select(
        "msg_id", "max_severity", F.array_join(rules.categories(), ", ").alias("cats"))
    return drained(spark, stream, "annotated-stream")


@query(o.sql([*o.CONTACT, *o.normalised("(SELECT DISTINCT upper(text) AS up FROM base_msg)", "up", "up", "un"),
              "uh AS (SELECT up, rule_id, category, severity, regexp_extract_all(norm, pattern, 0, 'i') AS hs FROM un, rules)",
              "us AS (SELECT up, max(severity) AS sev, string_agg(DISTINCT category, ', ' ORDER BY category) AS cats, sum(len(hs)) AS n FROM uh WHERE len(hs) > 0 GROUP BY 1)"],
             """SELECT msg_id, CAST(CASE WHEN ext THEN coalesce(sev, 0) ELSE 0 END AS INTEGER) AS max_severity,
             CASE WHEN ext THEN coalesce(us.cats, '') ELSE '' END AS cats, CAST(CASE WHEN ext THEN coalesce(n, 0) ELSE 0 END AS INTEGER) AS n_hits
             FROM base_msg LEFT JOIN us ON up = upper(text)"""))
def normalised_stream(spark, sf_dir):
    """Shouted messages: the stream brings texts to their normal form before it matches."""
    shouted = feed(spark, sf_dir).withColumn("text", F.upper("text"))
    stream = streams.annotate_stream(shouted, normalised=True).select(
        "msg_id", "max_severity", F.array_join(rules.categories(), ", ").alias("cats"), "n_hits")
    return drained(spark, stream, "normalised-stream")


# A reset row clears the window first: the messages since the last reset form a window of their own.
RESET = o.contact_ctes("contact_id, epoch", ", sum(CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch")


@query(o.sql(RESET, "SELECT contact_id, msg_id, CAST(window_len AS INTEGER) AS window_len, consec, score FROM win"))
def reset_stream(spark, sf_dir):
    stream = streams.stream_windows(feed(spark, sf_dir, F.col("msg_id") % 17 == 0)).select("contact_id", "msg_id", "window_len", "consec", "score")
    return drained(spark, stream, "reset-stream")
