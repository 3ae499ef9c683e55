"""Text normalisation over a message table, on the JVM throughout."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatrisk import config
from chatrisk.functions.sqltext import quote

UNICODE = "(?U)"
MARK = "\x01"


def closed_slang(slang=None) -> dict[str, str]:
    """Slang expansions with later rules already applied to the words earlier ones bring in."""
    pairs = config.SLANG if slang is None else slang
    closed = {}
    for i, (word, meaning) in enumerate(pairs):
        for later, text in pairs[i + 1:]:
            meaning = re.sub(rf"\b{re.escape(later)}\b", lambda _m, t=text: t, meaning)
        closed.setdefault(word, meaning)
    return closed


def _slang_regex(words) -> str:
    """Whole-word alternation, grouped by first letter so that most words fail on one character."""
    by_letter: dict[str, list[str]] = {}
    for word in sorted(words):
        by_letter.setdefault(word[0], []).append(re.escape(word[1:]))
    groups = [f"{re.escape(letter)}(?:{'|'.join(rest)})" for letter, rest in by_letter.items()]
    return rf"\b(?:{'|'.join(groups)})\b"


def nfkc(text: Column) -> Column:
    """Unicode NFKC; ASCII text is already in that form.

    The session's ICU library does the work, so the text never leaves the JVM.
    """
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(F.octet_length(text) != F.char_length(text), composed).otherwise(text)


def nfkc_arrow(text: Column) -> Column:
    """The same through Arrow batches, for a session without ICU."""
    @F.pandas_udf("string")
    def normalised(series):
        return series.str.normalize("NFKC")

    return normalised(text)


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def _replace(text: Column, pattern: str, replacement: str) -> Column:
    """Replace under Unicode rules; on ASCII text the plain, faster classes mean the same."""
    plain = F.regexp_replace(text, F.lit(pattern), F.lit(replacement))
    return F.when(is_ascii(text), plain).otherwise(F.regexp_replace(text, F.lit(UNICODE + pattern), F.lit(replacement)))


def mask_urls(text: Column) -> Column:
    """Expects lower case, as the other masks do."""
    return F.when(F.contains(text, F.lit("http")) | F.contains(text, F.lit("www.")), _replace(text, config.URL_PATTERN, "<URL>")).otherwise(text)


def mask_emails(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("@")), _replace(text, config.EMAIL_PATTERN, "<EMAIL>")).otherwise(text)


def mask_phones(text: Column) -> Column:
    return _replace(text, config.PHONE_PATTERN, "<PHONE>")


def collapse_repeats(text: Column) -> Column:
    """Three or more of the same character become two; newlines are left alone."""
    return F.regexp_replace(text, F.lit(r"([^\n])\1{2,}"), F.lit("$1$1"))


def expand_slang(text: Column, slang=None) -> Column:
    """Every slang word replaced in one pass: the words are marked, cut out and looked up."""
    closed = closed_slang(slang)
    table = F.expr(f"map({', '.join(quote(x) for pair in closed.items() for x in pair)})")

    def expanded(regex: str) -> Column:
        # Cutting at a single character needs no regex; text that holds the mark is cut by regex.
        marked = F.split(F.regexp_replace(text, F.lit(regex), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
        quick = F.array_join(F.transform(
            marked, lambda part, i: F.when(i % 2 == 1, F.element_at(table, part)).otherwise(part)), "")
        words = F.transform(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), lambda w: F.element_at(table, w))
        careful = F.array_join(F.zip_with(
            F.split(text, regex, -1), F.array_append(words, F.lit("")), lambda gap, word: F.concat(gap, word)), "")
        either = F.when(F.contains(text, F.lit(MARK)), careful).otherwise(quick)
        return F.when(F.rlike(text, F.lit(regex)), either).otherwise(text)

    regex = _slang_regex(closed)
    return F.when(is_ascii(text), expanded(regex)).otherwise(expanded(UNICODE + regex))


def collapse_spaces(text: Column) -> Column:
    return F.trim(_replace(text, r"\s+", " "))


def normalise(
    df: DataFrame, text: str = "text_raw", out: str = "norm", *, slang=None, compose=nfkc,
) -> DataFrame:
    """NFKC, lower case, URL, e-mail, phone, repeats, slang, spaces: in that order.

    Each step is a column of its own, so that no step is evaluated twice.
    """
    steps = [
        *([compose] if compose else []), F.lower, mask_urls, mask_emails, mask_phones,
        collapse_repeats, lambda t: expand_slang(t, slang), collapse_spaces,
    ]
    staged = df.withColumn("_step", F.coalesce(F.col(text), F.lit("")))
    for step in steps:
        staged = staged.withColumn("_step", step(F.col("_step")))
    return staged.withColumn(out, F.col("_step")).drop("_step")


def drop_empty(df: DataFrame, column: str = "norm") -> DataFrame:
    """Messages that still hold text after normalisation."""
    # Through a one-element array the filter stays above the normalisation, which then runs once.
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.explode_outer(F.array(column)).alias(column)).filter(F.col(column) != "")
