"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Measures are column expressions over the words and lines of a text; a rule is a measure with an allowed
range. Null and empty texts have no words and fail the base rule. Rows are independent, so repeated rows
and ties need no rule; extra columns pass through and give way to results of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Frequent function words, four languages.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "on", "with", "as", "was", "be", "by", "this", "are",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "nicht", "im", "sich", "auf", "des", "ein", "eine",
    "le", "la", "les", "et", "de", "un", "une", "du", "en", "que", "qui", "dans", "par", "pour", "est",
    "el", "los", "las", "y", "a", "se", "con", "una", "no", "es", "por", "para", "al",
]


@dataclass(frozen=True)
class Rule:
    """The text fails if `measure` is below `low` or above `high`; a null measure passes."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: Ratios are per word, per character in words, or per line.
RULES = (
    Rule("length", "n_words", low=50),
    Rule("repeated_words", "repeat_ratio", high=0.5),
    Rule("symbols", "symbol_ratio", high=0.05),
    Rule("word_length", "mean_word_chars", low=2.0, high=25.0),
    Rule("stop_words", "stop_ratio", low=0.005),
    Rule("duplicate_lines", "dup_line_ratio", high=0.6),
    Rule("shouting", "shout_ratio", high=0.5),
)


def measures(df: DataFrame) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the ratios the rules use."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, "[ \\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike("[^ \\x09-\\x0D]"))
    n = F.size("_words")
    windows = F.when(n < 3, F.array().cast("array<struct<h:bigint,p:int>>")).otherwise(
        F.sort_array(
            F.transform(
                F.sequence(F.lit(0), n - 3),
                lambda i: F.struct(
                    F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("p")
                ),
            )
        )
    )

    def repeated(window: Column, i: Column) -> Column:
        same = lambda j: F.coalesce(F.get("_windows", j)["h"] == window["h"], F.lit(False))
        return same(i - 1) | same(i + 1)

    starts = F.sort_array(F.transform(F.filter("_windows", repeated), lambda w: w["p"]))
    # Each repeated window covers its words up to the next repeated window, three at most.
    covered = F.aggregate(
        F.transform("_starts", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_starts", i + 1) - p, F.lit(3)))),
        F.lit(0).cast("bigint"), lambda a, x: a + x,
    )
    stops = F.size(F.filter("_words", lambda w: w.isin(STOP_WORDS)))
    per_word = lambda c: F.when(F.col("n_words") > 0, c / F.col("n_words"))
    return (
        df.withColumn("_words", words).withColumn("_lines", lines)
        .withColumn("_windows", windows).withColumn("_starts", starts)
        .withColumns({
            "n_words": n.cast("bigint"),
            "word_chars": F.length(F.translate(text, SPACES, "")).cast("bigint"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "n_repeat_words": covered,
            "n_stop_words": stops.cast("bigint"),
            "n_shouts": (F.length(text) - F.length(F.translate(text, "!", ""))).cast("bigint"),
            "n_lines": F.size("_lines").cast("bigint"),
        })
        .drop("_words", "_lines", "_windows", "_starts")
        .withColumns({
            "repeat_ratio": per_word(F.col("n_repeat_words")),
            "symbol_ratio": F.when(F.col("word_chars") > 0, F.col("n_symbols") / F.col("word_chars")),
            "mean_word_chars": per_word(F.col("word_chars")),
            "stop_ratio": per_word(F.col("n_stop_words")),
            "dup_line_ratio": F.when(F.col("n_lines") > 0, F.col("n_dup_lines") / F.col("n_lines")),
            "shout_ratio": per_word(F.col("n_shouts")),
        })
    )


def judged(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`df` with the measures, base_failed, the names of the failed rules and kept."""
    measured = measures(df)
    n, repeats = F.col("n_words"), F.col("n_repeat_words")
    verdicts = [F.when(_fails(r), F.lit(r.name)) for r in rules]
    return (
        measured.withColumn("base_failed", (n < 50) | (repeats * 100 > n * 50))
        .withColumn("failed_rules", F.array_compact(F.array(*verdicts)) if verdicts else F.array().cast("array<string>"))
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    )


def _fails(rule: Rule) -> Column:
    measure, fails = F.col(rule.measure), F.lit(False)
    if rule.low is not None:
        fails = fails | (measure < rule.low)
    if rule.high is not None:
        fails = fails | (measure > rule.high)
    return F.coalesce(fails, F.lit(False))
