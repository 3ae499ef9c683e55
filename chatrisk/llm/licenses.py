"""License scans by template-markup matching.

A template is wording with markup: `[[...]]` is a region that may be missing, `{{n}}` a replaceable region of at
most n words. It is compiled into an automaton over words; a text is accepted at a place where every mandatory word
matches exactly and in order, with nothing between but the marked regions. Phrases are templates without markup.

Texts are read whole; null and empty ones have no words, no labels and score 0. Rows are independent, so repeated
ids and ties need no rule: equal labels count once. An empty table gives an empty result; extra columns pass
through and give way to results of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from chatrisk.llm.batches import byte_texts, map_batches, plain

PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software {{8}} to deal in the software without restriction"),
    ("mit", "[[released]] [[licensed]] under the [[terms of the]] mit license"),
    ("apache-2.0", "licensed under the apache license [[version]] 2 0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted [[provided that the following conditions are met]]"),
    ("bsd", "under the [[terms of the]] bsd {{3}} license"),
    ("gpl-3.0", "[[gnu]] general public license [[as published by the free software foundation either]] [[v3]] [[version]] 3 [[0]]"),
    ("gpl-2.0", "[[gnu]] general public license [[as published by the free software foundation either]] [[v2]] [[version]] 2 [[0]]"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl-2.0", "mozilla public license [[v]] [[version]] 2 0"),
    ("cc-by-nc", "cc by nc [[sa]] [[nd]] {{1}} 0"),
    ("cc-by-sa", "cc by sa {{1}} 0"),
    ("cc-by", "creative commons attribution [[{{1}} 0]] [[international]] license"),
    ("cc0", "creative commons zero"),
    ("public-domain", "[[is]] in the public domain"),
    ("copyright", "copyright [[c]] {{2}} by {{4}} all rights reserved"),
    ("confidential", "may not be reproduced [[or distributed]] without [[prior]] written permission"),
)


@dataclass(frozen=True)
class Automaton:
    """States 0..accept; `words[s]` leads on to the next state, `skips[s]` lists states reached without a word, and
    in a state of `free` any word may be read, which leads on or not (the region has one state per word)."""

    label: str
    words: tuple[bytes | None, ...]
    skips: tuple[tuple[int, ...], ...]
    mandatory: int

    @property
    def accept(self) -> int:
        return len(self.words)

    def closed(self, states: set[int]) -> set[int]:
        todo, done = list(states), set(states)
        while todo:
            s = todo.pop()
            for t in self.skips[s] if s < self.accept else ():
                if t not in done:
                    done.add(t)
                    todo.append(t)
        return done

    def first_words(self) -> set[bytes | None]:
        return {self.words[s] for s in self.closed({0}) if s < self.accept}

    def match(self, words: list[bytes], at: int) -> int:
        """The end of the longest accepted stretch that starts at `at`, or -1."""
        states, end = self.closed({0}), -1
        for i in range(at, len(words)):
            states = self.closed({s + 1 for s in states if s < self.accept and self.words[s] in (None, words[i])})
            if self.accept in states:
                end = i + 1
            if not states:
                break
        return end


def compiled(label: str, template: str) -> Automaton:
    """The automaton of a template; None among its words stands for any word."""
    words: list[bytes | None] = []
    skips: list[list[int]] = []
    opened: list[int] = []
    mandatory = 0
    for token in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template):
        if token == "[[":
            opened.append(len(words))
            continue
        if token == "]]":
            start = opened.pop()
            _at(skips, start).append(len(words))
            continue
        if token.startswith("{{"):
            start, n = len(words), int(token[2:-2])
            for k in range(n):
                words.append(None)
                _at(skips, start + k).append(start + n)
            continue
        words.append(token.encode())
        mandatory += not opened
    _at(skips, len(words))
    return Automaton(label, tuple(words), tuple(tuple(s) for s in skips), mandatory)


def _at(skips: list[list[int]], place: int) -> list[int]:
    while len(skips) <= place:
        skips.append([])
    return skips[place]


class Scanner:
    """All phrases and templates, by the words a match may begin with."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.phrases = [(label, compiled(label, text)) for label, text in phrases]
        self.starts: dict[bytes, list[tuple[Automaton, bool]]] = {}
        for is_phrase, automaton in [(True, a) for _, a in self.phrases] + [(False, compiled(*t)) for t in templates]:
            for word in automaton.first_words():
                if word is None:
                    raise ValueError(f"the template of {automaton.label} begins with a replaceable region")
                self.starts.setdefault(word, []).append((automaton, is_phrase))

    def scan(self, words: list[bytes]) -> list[tuple[str, int, int, bool, int]]:
        """(label, start, end, is a phrase, mandatory words) of every match."""
        found = []
        for i, word in enumerate(words):
            for automaton, is_phrase in self.starts.get(word, ()):
                end = automaton.match(words, i)
                if end >= 0:
                    found.append((automaton.label, i, end, is_phrase, automaton.mandatory))
        return found


MATCHES = ArrayType(StructType([
    StructField("label", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()),
    StructField("phrase", IntegerType()), StructField("mandatory", IntegerType()),
]))
FIELDS = [StructField("n_words", LongType()), StructField("matches", MATCHES), StructField("score", DoubleType())]


def scanned(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """`docs` with n_words, matches (words from 0, end exclusive) and score: m / (m + 2) for the match with the most
    mandatory words m, 0 without a match."""
    kind = pa.list_(pa.struct([(f.name, pa.string() if f.name == "label" else pa.int32()) for f in MATCHES.elementType]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        scanner = Scanner(templates, phrases)
        names = [f.name for f in MATCHES.elementType]
        for batch in batches:
            sizes, matches, scores = [], [], []
            for text in byte_texts(batch.column("text")):
                words = plain(text)
                found = scanner.scan(words)
                most = max((m[4] for m in found), default=0)
                sizes.append(len(words))
                matches.append([dict(zip(names, (m[0], m[1], m[2], int(m[3]), m[4]))) for m in found])
                scores.append(most / (most + 2) if most else 0.0)
            yield batch, [pa.array(sizes, pa.int64()), pa.array(matches, kind), pa.array(scores, pa.float64())]

    return map_batches(docs, scan, FIELDS, docs.columns)


def with_digest(found: DataFrame) -> DataFrame:
    """n_base, first_word, last_word and base_labels of the phrases, labels of all matches."""
    base = F.filter("matches", lambda m: m["phrase"] == 1)
    starts = F.transform(base, lambda m: m["start"].cast("bigint"))
    names = lambda array: F.array_join(F.sort_array(F.array_distinct(F.transform(array, lambda m: m["label"]))), ",")
    new = ("matches", "score", "n_base", "first_word", "last_word", "base_labels", "labels")
    return found.select(
        *[c for c in found.columns if c not in new], F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("matches")).alias("labels"), "score",
    )
