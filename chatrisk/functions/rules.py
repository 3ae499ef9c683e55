"""Rule matching as column expressions: every occurrence of every pattern, in catalog order.

A regex is tried on a message only when one of the words its match must contain is there; one
pass finds all those words, so ordinary messages cost that pass alone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatrisk.functions.catalog import DEFAULT, MASK_BITS, Catalog
from chatrisk.functions.scoring import word_name
from chatrisk.functions.sqltext import name, quote
from chatrisk.plans.joins import lookup_join

REGEX_FLAGS = "(?iU)"  # ignore case, Unicode classes and folding
# Characters that match an ASCII letter when case is ignored but do not lower-case to it alone.
FOLDED = ("\u017f\u0131\u212a\u0130", "siki")
_HIT = "STRUCT<rule_id: INT, category: STRING, severity: INT, text: STRING>"
# Noncharacters around hits while their places are counted; those of the text itself stand in as the next two.
MARKS, STAND_INS = "\ufdd0\ufdd1", "\ufdd2\ufdd3"
_SPAN_HIT = "STRUCT<rule_id: INT, category: STRING, severity: INT, start: INT, end: INT, text: STRING>"


def word_regex(words) -> str:
    """Any of the words, grouped by first letter so that most positions fail on one character."""
    by_letter: dict[str, list[str]] = {}
    for word in sorted(words):
        by_letter.setdefault(word[0], []).append(re.escape(word[1:]))
    return "|".join(f"{re.escape(letter)}(?:{'|'.join(rest)})" for letter, rest in by_letter.items())


def lowered(text: str) -> Column:
    """The text in lower case, in which the words are looked for."""
    column = name(text)
    folded = f"translate({column}, {quote(FOLDED[0])}, {quote(FOLDED[1])})"
    return F.expr(f"lower(CASE WHEN octet_length({column}) = char_length({column}) THEN {column} ELSE {folded} END)")


def candidate_rules(low: str, catalog: Catalog) -> Column:
    """Ids of the gated rules that the words of a lowered text leave possible."""
    rules_of: dict[str, list[int]] = {}
    for i, anchor in enumerate(catalog.anchors):
        for word in anchor or ():
            rules_of.setdefault(word, []).append(i)
    if not rules_of:
        return F.array().cast("array<int>")
    low, regex = name(low), word_regex(rules_of)
    table = ", ".join(f"{quote(w)}, array({', '.join(map(str, ids))})" for w, ids in rules_of.items())
    # The look-ahead finds a word at every position, overlapping ones included.
    words = f"regexp_extract_all({low}, {quote(f'(?=({regex}))')}, 1)"
    return F.expr(
        f"CASE WHEN rlike({low}, {quote(regex)}) THEN array_distinct(flatten(transform(array_distinct({words}), w -> element_at(map({table}), w)))) "
        f"ELSE CAST(array() AS ARRAY<INT>) END")


def matches_sql(text: str, candidates: str, catalog: Catalog, spans: bool, gate: bool) -> str:
    """Per rule the list of its hits, then one pass that labels and joins the lists."""
    hit = _SPAN_HIT if spans else _HIT

    def per_rule(call: str) -> str:
        lists = []
        for i, ((_, _, pattern), anchor) in enumerate(zip(catalog.rules, catalog.anchors)):
            found = call.format(quote(REGEX_FLAGS + pattern))
            gated = gate and anchor
            lists.append(f"CASE WHEN array_contains({candidates}, {i}) THEN {found} END" if gated else found)
        return f"array({', '.join(lists)})"

    category = f"element_at(array({', '.join(quote(c) for c, _, _ in catalog.rules)}), r + 1)"
    severity = f"element_at(array({', '.join(str(s) for _, s, _ in catalog.rules)}), r + 1)"
    head = f"'rule_id', r, 'category', {category}, 'severity', {severity}"
    empty = f"CAST(array() AS ARRAY<{hit}>)"
    if spans:
        # One pass of a pattern puts marks around its hits. What stands between marks is gap, hit, gap and so on, and
        # the running sum of the lengths gives every place; an array of one element binds a value for what follows.
        opening, closing = MARKS
        plain = f"translate({text}, {quote(MARKS)}, {quote(STAND_INS)})"
        found = per_rule(f"regexp_replace({plain}, {{}}, {quote(f'{opening}$0{closing}')})")
        ends = "aggregate(parts, array(0), (ends, s) -> array_append(ends, element_at(ends, -1) + char_length(s)))"
        start, end = "element_at(ends, 2 * i)", "element_at(ends, 2 * i + 1)"
        body = f"named_struct({head}, 'start', {start}, 'end', {end}, 'text', substring({text}, {start} + 1, {end} - {start}))"
        hits = f"transform(array({ends}), ends -> transform(sequence(1, CAST(size(parts) div 2 AS INT)), i -> {body}))[0]"
        parted = f"transform(array(split(m, {quote(f'[{MARKS}]')}, -1)), parts -> {hits})[0]"
        labelled = f"transform({found}, (m, r) -> IF(contains(m, {quote(opening)}), {parted}, {empty}))"
    else:
        found = per_rule(f"regexp_extract_all({text}, {{}}, 0)")
        body = f"named_struct({head}, 'text', h)"
        labelled = f"transform({found}, (hs, r) -> coalesce(transform(hs, (h, i) -> {body}), {empty}))"
    every = f"flatten({labelled})"
    if not gate or not all(catalog.anchors):
        return every
    return f"CASE WHEN size({candidates}) > 0 THEN {every} ELSE {empty} END"


def with_matches(
    df: DataFrame, text: str = "text", catalog: Catalog = DEFAULT, *,
    when: Column | None = None, spans: bool = False, gate: bool = True, out: str = "matches",
) -> DataFrame:
    """Add `matches`, the hits of every rule on `text`; rows failing `when` get an empty list."""
    allowed = F.lit(True) if when is None else F.coalesce(when, F.lit(False))
    staged = df.withColumn("_text", F.when(allowed, F.coalesce(F.col(text), F.lit(""))).otherwise(F.lit("")))
    # Lowering costs as much as the pass over the words; as a column of its own it is done once.
    staged = staged.withColumn("_low", lowered("_text")).withColumn("_candidates", candidate_rules("_low", catalog))
    matches = F.expr(matches_sql("_text", "_candidates", catalog, spans, gate))
    return staged.withColumn(out, matches).drop("_text", "_low", "_candidates")


def max_severity(matches: str = "matches") -> Column:
    """Highest severity, 0 without a hit."""
    return F.coalesce(F.array_max(F.col(f"{matches}.severity")), F.lit(0))


def has_critical(matches: str = "matches") -> Column:
    return F.array_contains(F.col(f"{matches}.severity"), 3)


def categories(matches: str = "matches") -> Column:
    """Sorted distinct categories."""
    return F.sort_array(F.array_distinct(F.col(f"{matches}.category")))


def category_masks(catalog: Catalog = DEFAULT, matches: str = "matches", out: str = "cat_mask") -> dict[str, Column]:
    """One bit per category, in catalog order, over as many words as the catalog needs; 0 without a hit."""
    masks = {}
    for word in range(catalog.mask_words):
        names = f"array({', '.join(map(quote, catalog.categories[word * MASK_BITS:(word + 1) * MASK_BITS]))})"
        place = f"array_position({names}, m.category)"
        bit = f"shiftleft(1L, CAST({place} - 1 AS INT))"
        added = bit if catalog.mask_words == 1 else f"IF({place} > 0, {bit}, 0L)"
        masks[word_name(out, word)] = F.expr(f"aggregate({matches}, 0L, (mask, m) -> mask | {added})")
    return masks


def mask_categories(mask: str, catalog: Catalog = DEFAULT) -> Column:
    """Sorted category names of a mask."""
    found = []
    for word in range(catalog.mask_words):
        names = sorted(catalog.categories[word * MASK_BITS:(word + 1) * MASK_BITS])
        bits = ", ".join(f"{catalog.bit(c) >> word * MASK_BITS}L" for c in names)
        found.append(
            f"filter(array({', '.join(map(quote, names))}), (c, i) -> ({word_name(mask, word)} & element_at(array({bits}), i + 1)) != 0)")
    return F.expr(found[0] if len(found) == 1 else f"array_sort(concat({', '.join(found)}))")


def rule_tags(matches: str = "matches") -> Column:
    """(category, severity) pairs of a message, each once, in order of first appearance."""
    return F.array_distinct(
        F.transform(matches, lambda m: F.struct(m["category"].alias("category"), m["severity"].alias("severity")))
    )


def with_summary(df: DataFrame, catalog: Catalog = DEFAULT, matches: str = "matches") -> DataFrame:
    """Add max_severity, cat_mask, n_hits and critical, derived from the hits; a catalog of more categories than
    one word holds adds cat_mask_1 and so on."""
    return df.withColumns({
        "max_severity": max_severity(matches),
        **category_masks(catalog, matches),
        "n_hits": F.size(matches),
        "critical": has_critical(matches),
    })


def with_patterns(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Hits (a row each) with the pattern of their rule; `rules` is a catalog's table, one row per rule."""
    return lookup_join(hits, rules.select("rule_id", "pattern"), ["rule_id"])


def explode_hits(df: DataFrame, *keys: str, matches: str = "matches") -> DataFrame:
    """One row per hit, numbered per rule within its message."""
    # The outer form keeps Spark from testing the list, and so matching, a second time below.
    hit = df.select(*keys, F.posexplode_outer(matches).alias("_pos", "_hit"), F.col(f"{matches}.rule_id").alias("_rules"))
    first = F.array_position("_rules", F.col("_hit.rule_id")) - 1
    return hit.filter(F.col("_hit").isNotNull()).select(*keys, (F.col("_pos") - first).cast("int").alias("hit_no"), "_hit.*")
