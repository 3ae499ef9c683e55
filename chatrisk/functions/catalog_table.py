"""Rule catalogs kept as a table of any number of rules.

An automaton over the words that the rules cannot match without reads a text once and names the rules that are left
possible; only their patterns are tried, as data and not as an expression each. Rules that begin with the same word
are tried together where the word stands.

Hits are those of the unrolled form, which runs in the session's regex engine. Python's engine, where a pattern is
compiled once per worker, finds them for the plain patterns (`_is_plain`) in texts of plain characters (`PLAIN_TEXT`):
there the two engines cannot differ. All others run in the session's engine, which compiles a pattern for each row.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress, repeat
from re import _parser as _regex_parser

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatrisk.functions.catalog import _required_words
from chatrisk.functions.rules import _HIT, FOLDED, REGEX_FLAGS
from chatrisk.plans.workers import once_per_worker

CATALOG_SCHEMA = "rule_id INT, category STRING, severity INT, pattern STRING"
#: A catalog is held by the driver and every worker; larger ones are an error, not a truncation.
MOST_RULES = 200_000
_RULE = "STRUCT<rule_id: INT, category: STRING, severity: INT, pattern: STRING>"
#: Rules tried by one pattern, and between two tests of the text's length; texts whose hits are held as Python objects.
TRIED_AT_ONCE = 64
GUARDED = 8
#: With more places of its word in a text, a rule goes through the text alone and skips what its hits cover.
FEW_PLACES = 4
HELD_TEXTS = 512

_QUOTES = "\u2018\u2019\u201c\u201d\u2013\u2014\u2026"


def _plain_characters() -> str:
    """Characters that both engines class alike: letters, punctuation and signs of Unicode's old blocks. Control
    characters, marks, numbers beyond digits, and what folds to an ASCII letter are not among them."""
    kinds = {"Lu", "Ll", "Lt", "Lo", "Lm", "Po", "Ps", "Pe", "Pi", "Pf", "Pd", "Sc", "Sm"}
    other = [*range(0xA1, 0x530), *range(0x2010, 0x2028), *range(0x2030, 0x203F)]
    return "".join(c for c in map(chr, [9, *range(32, 127), *other]) if (c.isascii() or unicodedata.category(c) in kinds) and c not in FOLDED[0])


PLAIN_TEXT = re.compile(f"[{re.escape(_plain_characters())}]*")
_ESCAPE = r"\\[dDwWsS.?*+()\[\]{}|^$\\/-]"
_RANGE = r"[a-z]-[a-z]|[A-Z]-[A-Z]|[0-9]-[0-9]"
_CLASS = rf"\[\^?(?:{_RANGE}|{_ESCAPE}|[A-Za-z0-9 _,;:'\"!@%<>=/.?*+()$|{_QUOTES}])+\]"
_ATOM = rf"[A-Za-z0-9 _,;:'\"!@%<>=/#~`&-]|[{_QUOTES}]|{_ESCAPE}|\\b|\.|{_CLASS}|[|^$)]|\((?:\?:|(?!\?))"
#: Syntax that both engines read alike: no flags, look-around, back references, or possessive and odd quantifiers.
PLAIN_SYNTAX = re.compile(rf"(?:(?:{_ATOM})(?:(?:[*+?]|\{{\d+(?:,\d*)?\}})\??(?![*+?{{]))?)+")


def _simple_repeats(sequence) -> bool:
    """Whether nothing but single characters is repeated; a group may stand once or not at all."""
    for op, arg in sequence:
        if str(op) in ("MAX_REPEAT", "MIN_REPEAT"):
            body = arg[2]
            if arg[1] > 1 and not (len(body) == 1 and str(body[0][0]) in ("LITERAL", "NOT_LITERAL", "ANY", "IN")):
                return False
            if not _simple_repeats(body):
                return False
        elif str(op) == "SUBPATTERN" and not _simple_repeats(arg[-1]):
            return False
        elif str(op) == "BRANCH" and not all(map(_simple_repeats, arg[1])):
            return False
    return True


def _is_plain(pattern: str) -> bool:
    """Whether both engines give the same hits of a pattern in plain texts."""
    if not PLAIN_SYNTAX.fullmatch(pattern):
        return False
    parsed = _regex_parser.parse(pattern)
    return parsed.getwidth()[0] > 0 and _simple_repeats(parsed)


def _parted(pattern: str, word: str) -> tuple[str, str] | None:
    """A plain pattern that begins with a word, at its bounds or not, in two: what ends with the word, and the rest.

    The first part matches in one way only, so the rest can be tried on its own.
    """
    parts = re.fullmatch(rf"((?:\\b|\^)*{re.escape(word)}(?:\\b)*)((?![*+?{{]).*)", pattern, re.IGNORECASE)
    return parts.groups() if parts and "|" not in pattern and re.fullmatch(r"[\w ']+", word) else None


@dataclass(frozen=True)
class RuleTable:
    """Rules in order of their id, with the words that each needs; a rule without such words is always tried."""

    rules: tuple[tuple[int, str, int, str], ...]
    words: tuple[tuple[str, ...] | None, ...]
    key: str

    @classmethod
    def of(cls, rows: list[tuple[int, str, int, str]]) -> RuleTable:
        rows = sorted((int(i), c, int(s), p) for i, c, s, p in rows)
        if len({i for i, *_ in rows}) < len(rows):
            raise ValueError("a rule id occurs twice")
        for i, category, severity, pattern in rows:
            if severity not in (1, 2, 3) or not category:
                raise ValueError(f"rule {i}: severity must be 1, 2 or 3, and the category not empty")
            if re.compile(pattern, re.IGNORECASE).search("") is not None:
                raise ValueError(f"rule {i}: the pattern matches the empty text")
        return cls(tuple(rows), tuple(_required_words(p) for *_, p in rows), hashlib.sha256(repr(rows).encode()).hexdigest())


def read_catalog(rules: DataFrame) -> RuleTable:
    """The rules of a table with the columns of CATALOG_SCHEMA."""
    rows = rules.select("rule_id", "category", "severity", "pattern").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"a catalog holds at most {MOST_RULES} rules")
    return RuleTable.of([tuple(r) for r in rows])


class _Hits:
    """Hits as they are found: the rule's place in the table, and the text in two parts."""

    def __init__(self):
        self.places: list[int] = []
        self.heads: list[str] = []
        self.tails: list[str] = []


class _Together:
    """Plain rules that begin with the same word, all tried where it stands, as (place, first part, rest)."""

    def __init__(self, word: str, rules: list[tuple[int, str, str]]):
        widths = {k: _regex_parser.parse(rest).getwidth()[0] for k, _, rest in rules}
        alike: dict[str, list[tuple[int, str]]] = {}
        for k, first, rest in sorted(rules, key=lambda rule: widths[rule[0]]):
            alike.setdefault(first, []).append((k, rest))
        self.word, self.places, self.groups, held, parts = len(word), [], [0], 0, []
        for first, own in alike.items():
            tries = []
            for k, rest in own:
                self.places.append(k)
                self.groups.append(held + 1)
                held += 1 + re.compile(rest).groups
                tries.append(f"(?=({rest})|)")
            tried = ""
            for i in reversed(range(0, len(own), GUARDED)):  # the text must be long enough for what is tried from here on
                tried = f"(?:(?=(?s:.{{{widths[own[i][0]]}}})){''.join(tries[i : i + GUARDED])}{tried}|)"
            parts.append(f"(?=(?:{first}{tried})|)")
        self.single, self.filled = held == len(self.places), min(widths.values()) > 0
        self.match = re.compile("".join(parts), re.IGNORECASE).match

    def hits(self, text: str, starts: list[int], out: _Hits) -> None:
        """Add the hits of all rules; a rule's next hit begins where its last one ended, or later."""
        if len(starts) == 1 and self.filled:
            at = starts[0]
            match = self.match(text, at)
            tails = match.groups() if self.single else match.group(*self.groups)[1:]
            out.places += compress(self.places, tails)
            out.tails += filter(None, tails)
            out.heads += repeat(text[at : at + self.word], len(out.tails) - len(out.heads))
            return
        ends: dict[int, int] = {}
        for at in starts:
            for k, tail in zip(self.places, self.match(text, at).group(*self.groups)[1:]):
                if tail is not None and at >= ends.get(k, 0):
                    out.places.append(k)
                    out.heads.append(text[at : at + self.word])
                    out.tails.append(tail)
                    ends[k] = at + self.word + len(tail)


class _Automaton:
    """Finds, in one pass over a text, the rules left possible, and the hits of the plain ones."""

    def __init__(self, table: RuleTable):
        self.always = [k for k, words in enumerate(table.words) if not words]
        self.rows = pa.array(
            [dict(zip(("rule_id", "category", "severity", "pattern"), (i, c, s, REGEX_FLAGS + p))) for i, c, s, p in table.rules],
            pa.struct([("rule_id", pa.int32()), ("category", pa.string()), ("severity", pa.int32()), ("pattern", pa.string())]))
        self.patterns = [p for *_, p in table.rules]
        self.plain = [_is_plain(p) for p in self.patterns]
        self.compiled: dict[int, re.Pattern] = {}
        of_word: dict[str, list[int]] = {}
        for k, words in enumerate(table.words):
            for word in words or ():
                of_word.setdefault(word, []).append(k)
        self.words = ahocorasick.Automaton()
        for word, places in of_word.items():
            parted = {k: _parted(self.patterns[k], word) for k in places if self.plain[k]}
            alone = [k for k in places if not parted.get(k)]
            begun = [(k, *p) for k, p in parted.items() if p]
            together = [_Together(word, begun[i : i + TRIED_AT_ONCE]) for i in range(0, len(begun), TRIED_AT_ONCE)]
            self.words.add_word(word, (len(word), places, together, alone))
        self.words.make_automaton()
        self.folded = str.maketrans(*FOLDED)

    def possible(self, text: str) -> list[int]:
        found = set(self.always)
        if len(self.words):
            plain = text if text.isascii() else text.translate(self.folded)
            for _, (_, places, _, _) in self.words.iter(plain.lower()):
                found.update(places)
        return sorted(found)

    def hits(self, text: str, out: _Hits) -> list[int]:
        """Add the hits in a plain text, unordered by rule; gives the possible rules that are not plain, in order."""
        stands: dict[int, tuple[tuple, list[int]]] = {}
        if len(self.words):
            for end, entry in self.words.iter(text.lower()):
                stands.setdefault(id(entry), (entry, []))[1].append(end - entry[0] + 1)
        alone = set(self.always)
        for (_, places, together, others), starts in stands.values():
            if len(starts) > FEW_PLACES:
                alone.update(places)
                continue
            for rules in together:
                rules.hits(text, starts, out)
            alone.update(others)
        left = []
        for k in sorted(alone):
            if not self.plain[k]:
                left.append(k)
                continue
            if k not in self.compiled:
                self.compiled[k] = re.compile(self.patterns[k], re.IGNORECASE)
            found = [m.group() for m in self.compiled[k].finditer(text)]
            out.places += [k] * len(found)
            out.heads += found
            out.tails += [""] * len(found)
        return left

    def found(self, texts: list[str | None]) -> pa.StructArray:
        """Per text the hits of plain rules and the rules left to the session's engine, both in order of the rules."""
        out, ends, left, left_ends = _Hits(), [0], [], [0]
        for text in texts:
            if text and PLAIN_TEXT.fullmatch(text):
                left += self.hits(text, out)
            elif text:
                left += self.possible(text)
            ends.append(len(out.places))
            left_ends.append(len(left))
        places = np.array(out.places, np.int64)
        order = np.argsort(np.repeat(np.arange(len(texts)), np.diff(ends)) * len(self.patterns) + places, kind="stable")
        named = self.rows.take(pa.array(places[order]))
        fields = ["rule_id", "category", "severity"]
        hits = pc.binary_join_element_wise(pa.array(out.heads, pa.string()), pa.array(out.tails, pa.string()), "").take(pa.array(order))
        found = pa.StructArray.from_arrays([*map(named.field, fields), hits], names=[*fields, "text"])
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found),
             pa.ListArray.from_arrays(pa.array(left_ends, pa.int32()), self.rows.take(pa.array(left, pa.int64())))], names=["hits", "left"])


def _cut(texts: pa.Array) -> Iterator[list[str | None]]:
    for at in range(0, max(len(texts), 1), HELD_TEXTS):
        yield texts.slice(at, HELD_TEXTS).to_pylist()


def found_hits(spark: SparkSession, table: RuleTable, text: str) -> Column:
    """A text's hits of plain rules, and the possible rules left to try, both in order."""
    sent = spark.sparkContext.broadcast(table)
    key = ("automaton", table.key)

    @F.arrow_udf(f"STRUCT<hits: ARRAY<{_HIT}>, left: ARRAY<{_RULE}>>")
    def found(texts: pa.Array) -> pa.Array:
        automaton = once_per_worker(key, lambda: _Automaton(sent.value))
        return pa.concat_arrays([automaton.found(part) for part in _cut(texts)])

    return found(F.col(text))


def with_table_matches(df: DataFrame, table: RuleTable, text: str = "text", *, when: Column | None = None, out: str = "matches") -> DataFrame:
    """Add `matches` as `with_matches` does, for a catalog given as a table; rows failing `when` get an empty list."""
    allowed = F.lit(True) if when is None else F.coalesce(when, F.lit(False))
    staged = df.withColumn("_text", F.when(allowed, F.coalesce(F.col(text), F.lit(""))).otherwise(F.lit("")))
    staged = staged.withColumn("_found", found_hits(df.sparkSession, table, "_text"))
    left = (
        "flatten(transform(_found.left, c -> transform(regexp_extract_all(_text, c.pattern, 0), h -> named_struct("
        "'rule_id', c.rule_id, 'category', c.category, 'severity', c.severity, 'text', h))))")
    # The sort keeps the order of a rule's hits.
    by_rule = "(a, b) -> CASE WHEN a.rule_id < b.rule_id THEN -1 WHEN a.rule_id > b.rule_id THEN 1 ELSE 0 END"
    hits = F.expr(f"CASE WHEN size(_found.left) = 0 THEN _found.hits ELSE array_sort(concat(_found.hits, {left}), {by_rule}) END")
    return staged.withColumn(out, F.coalesce(hits, F.expr(f"CAST(array() AS ARRAY<{_HIT}>)"))).drop("_text", "_found")
