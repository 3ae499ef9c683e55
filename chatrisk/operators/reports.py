"""Rankings, readable texts, histograms and summaries over parsed records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatrisk.plans.checkpoints import checkpointed
from chatrisk.plans.joins import lookup_join
from chatrisk.plans.skew import PIECE_ROWS, with_position

LEVELS = ["HIGH", "MEDIUM", "LOW", "UNKNOWN"]
FILE_ORDER = ("_file", "_row")
LINE = 70  # width of the rules between conversations


def with_file_order(files: DataFrame) -> DataFrame:
    """Add the file of every row, and its place in it, to a table as read from Parquet files."""
    return files.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})


def report_order() -> list[Column]:
    return [F.desc("risk_order"), F.desc("sev3_hits"), F.desc("total_rule_hits"), F.asc("conversation_id")]


def ranked_report(
    records: DataFrame, *, only_positive: bool = False, limit: int | None = None, piece_rows: int = PIECE_ROWS,
    first_by: Sequence[str] = ("conversation_id",),
) -> DataFrame:
    """Records with their 1-based place; the limit takes the first records by `first_by`, before ranking.

    For the first records of the files they were read from, add the place with `with_file_order` when reading and
    give FILE_ORDER here.
    """
    if only_positive:
        records = records.filter("label = 1")
    if limit is not None:
        records = records.orderBy(*first_by).limit(limit)
    records = records.drop(*FILE_ORDER)
    bodies = checkpointed(records, "records") if "messages" in records.columns else None
    if bodies is not None:  # the order is found from numbers alone; messages are joined to their places
        records = bodies.select("conversation_id", "risk_order", "sev3_hits", "total_rule_hits")
    negated = records.withColumns({"_r": -F.col("risk_order"), "_s": -F.col("sev3_hits"), "_t": -F.col("total_rule_hits")})
    placed = with_position(negated, [], ["_r", "_s", "_t", "conversation_id"], "_pos", piece_rows)
    ranked = placed.withColumn("idx", F.col("_pos") + 1).drop("_r", "_s", "_t", "_pos")
    return ranked if bodies is None else lookup_join(bodies, ranked.select("conversation_id", "idx"), ["conversation_id"], "inner")


def top_report(records: DataFrame, k: int) -> DataFrame:
    """The k highest-ranked records."""
    return records.orderBy(*report_order()).limit(k)


def categories_by_count() -> Column:
    """(category, n) entries of cat_counts, most frequent first, then by first appearance."""
    entries = F.map_entries("cat_counts")
    placed = F.transform(entries, lambda e, i: F.struct((-e["value"]).alias("n"), i.alias("i"), e["key"].alias("category")))
    return F.transform(F.array_sort(placed), lambda e: F.struct(e["category"].alias("category"), (-e["n"]).alias("n")))


def _head(index: str) -> list[Column]:
    """The lines in front of a conversation's messages; null where one does not apply."""
    mark = lambda column, text: F.when(F.col(column), F.lit(text)).otherwise(F.lit(""))
    head = F.concat(
        F.lit("#"), F.col(index), F.lit("  ["), F.col("label_str"), F.lit("]  RISK:"), F.col("risk_level"),
        mark("escalation", "  ESC"), mark("arc", "  ARC"), mark("dominance", "  DOM"))
    counts = F.array_join(F.transform(categories_by_count(), lambda e: F.concat(e["category"], F.lit(":"), e["n"])), "  ")
    return [
        F.lit("=" * LINE), head, F.concat(F.lit("id="), F.col("conversation_id")),
        F.when(F.size("categories") > 0, F.concat(F.lit("cats="), F.array_join("categories", ", "))),
        F.when(F.size("cat_counts") > 0, F.concat(F.lit("rules="), counts)), F.lit("-" * LINE)]


def _message_line(message: Column) -> Column:
    tags = F.array_join(F.transform(message["rules"], lambda r: F.concat(
        F.lit("["), r["category"], F.lit(":"), r["severity"], F.lit("]"))), " ")
    return F.concat(
        F.lit("["), message["role"], F.lit("]"), F.when(tags == "", "").otherwise(F.concat(F.lit("  "), tags)),
        F.lit("  "), message["text"])


def readable_lines(ranked: DataFrame, parts: DataFrame) -> DataFrame:
    """(idx, part, at, value): the lines of `readable_text`, in the order of the first three, for conversations of any
    size. `ranked` holds records without messages and their place, `parts` (conversation_id, part, messages)."""
    first, last = F.lit(-1), F.lit((1 << 31) - 1)
    head = ranked.select("idx", first.alias("part"), F.posexplode(F.array_compact(F.array(*_head("idx")))).alias("at", "value"))
    tail = ranked.select("idx", last.alias("part"), F.lit(0).alias("at"), F.lit("").alias("value"))
    placed = lookup_join(parts, ranked.select("conversation_id", "idx"), ["conversation_id"], "inner")
    body = placed.select("idx", "part", F.posexplode(F.transform("messages", _message_line)).alias("at", "value"))
    return head.unionByName(body).unionByName(tail)


def readable_text(index: str = "idx") -> Column:
    """A conversation as lines of text, in one row."""
    return F.concat_ws("\n", *_head(index), F.transform("messages", _message_line), F.lit(""))


def level_counts(records: DataFrame) -> DataFrame:
    """Conversations per label and level; both labels have a row, also without conversations."""
    labels = records.sparkSession.range(2).select(F.col("id").cast(records.schema["label"].dataType).alias("label"))
    every = records.select("label", "risk_level").unionByName(labels.withColumn("risk_level", F.lit(None).cast("string")))
    pivoted = every.groupBy("label").pivot("risk_level", LEVELS).agg(F.count(F.lit(1)))
    return pivoted.fillna(0, subset=LEVELS)


def flag_rates(records: DataFrame) -> DataFrame:
    """Share in percent of escalation, arc and dominance, for both labels even when one is absent."""
    rate = lambda flag, label: F.round(F.coalesce(
        F.avg(F.when(F.col("label") == label, F.col(flag).cast("int"))) * 100, F.lit(0.0)), 6)
    flags = ["escalation", "arc", "dominance"]
    rates = records.agg(*[rate(f, label).alias(f"{f}_{label}") for f in flags for label in (1, 0)])
    rows = [F.struct(F.lit(label).alias("label"), *[F.col(f"{f}_{label}").alias(f) for f in flags]) for label in (1, 0)]
    return rates.select(F.inline(F.array(*rows)))


def category_totals(records: DataFrame) -> DataFrame:
    """Tag counts per category over positive conversations."""
    tags = records.filter("label = 1").select(F.explode("cat_counts").alias("category", "n"))
    return tags.groupBy("category").agg(F.sum("n").alias("hits"))


def top_categories(records: DataFrame, n: int = 20) -> DataFrame:
    return category_totals(records).orderBy(F.desc("hits"), "category").limit(n)


def _with_empty_bins(binned: DataFrame, last_bin: Column) -> DataFrame:
    """(label, bin, n, width) for both labels and bins 0..last; `binned` has few rows by now."""
    row = binned.agg(
        F.collect_list(F.struct("label", "bin", "n")).alias("_counts"), last_bin.cast("int").alias("_last"),
        F.max("width").alias("width"))
    grid = row.withColumn("label", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "bin", F.explode(F.sequence(F.lit(0), F.coalesce("_last", F.lit(0)))))
    n = F.expr("aggregate(filter(_counts, c -> c.label = label AND c.bin = bin), 0L, (s, c) -> s + c.n)")
    return grid.select("label", "bin", n.alias("n"), "width")


def category_histogram(records: DataFrame) -> DataFrame:
    """Conversations per label and number of categories, from 0 to the highest."""
    counts = records.groupBy("label", F.col("n_categories").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return _with_empty_bins(counts.withColumn("width", F.lit(1.0)), F.max("bin")).drop("width")


def severity_histogram(records: DataFrame, max_edges: int = 20) -> DataFrame:
    """Conversations per label and number of severity-3 hits; unit bins, the last one closed.

    With edges 0..e the last bin holds e-1 and e, and larger values fall outside. Values beyond the
    last possible edge are counted as one, which leaves at most `max_edges` + 1 rows per label.
    """
    values = records.groupBy("label", F.least("sev3_hits", F.lit(max_edges)).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    highest = values.select(F.max("v")).scalar()
    edge = F.least(F.greatest(highest, F.lit(1)) + 1, F.lit(max_edges - 1))
    binned = values.withColumn("_edge", edge).withColumn("_out", F.col("v") > F.col("_edge"))
    binned = binned.groupBy("label", F.least(F.col("v"), F.col("_edge") - 1).alias("bin"), "_edge").agg(
        F.sum(F.when(F.col("_out"), 0).otherwise(F.col("n"))).alias("n"), F.lit(1.0).alias("width"))
    return _with_empty_bins(binned, F.max("_edge") - 1).drop("width")


def hits_histogram(records: DataFrame, max_edges: int = 40) -> DataFrame:
    """Conversations per label and equal-width bin of the total hits over [0, highest + 1]."""
    values = records.groupBy("label", F.col("total_rule_hits").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    highest = F.greatest(values.select(F.max("v")).scalar(), F.lit(1))
    shaped = values.withColumn("_end", highest + 1).withColumn("_bins", F.least(F.col("_end") + 1, F.lit(max_edges)) - 1)
    bucket = F.least(F.floor(F.col("v") * F.col("_bins") / F.col("_end")), F.col("_bins") - 1).cast("int")
    binned = shaped.groupBy("label", bucket.alias("bin"), "_bins", (F.col("_end") / F.col("_bins")).alias("width")).agg(F.sum("n").alias("n"))
    filled = _with_empty_bins(binned, F.max("_bins") - 1)
    return filled.select("label", "bin", F.round(F.col("bin") * F.col("width"), 6).alias("low"), "n")


def split_summary(records: DataFrame) -> DataFrame:
    """Conversations and the three levels per label."""
    return level_counts(records).select(
        "label", (F.col("HIGH") + F.col("MEDIUM") + F.col("LOW") + F.col("UNKNOWN")).alias("total"), "HIGH", "MEDIUM", "LOW")
