"""Rule catalogs: validation, category bits, and the words a match cannot do without."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from chatrisk import config

try:
    from re import _parser as _regex_parser
except ImportError:  # older Python
    import sre_parse as _regex_parser

#: Categories in one BIGINT of a mask; a catalog with more of them has masks of several words.
MASK_BITS = 63
# Words too frequent in chat to tell anything; a rarer required word is preferred to them.
FREQUENT = {
    "you", "your", "are", "the", "what", "how", "have", "when", "where", "like", "just", "don",
    "let", "can", "see", "make", "time", "out", "come", "with", "know", "would",
}


@dataclass(frozen=True)
class Catalog:
    """Ordered rules plus the weights, pairs and groups that score them."""

    rules: tuple[tuple[str, int, str], ...]
    weights: dict[str, float] = field(default_factory=lambda: dict(config.CATEGORY_WEIGHTS))
    pairs: tuple[tuple[str, str, float], ...] = tuple(config.PAIR_BONUSES)
    trust: tuple[str, ...] = tuple(config.TRUST)
    solicit: tuple[str, ...] = tuple(config.SOLICIT)
    control: tuple[str, ...] = tuple(config.CONTROL)

    def __post_init__(self):
        if not self.rules:
            raise ValueError("a catalog needs at least one rule")
        for category, severity, pattern in self.rules:
            if severity not in (1, 2, 3):
                raise ValueError(f"severity must be 1, 2 or 3: {category} {severity}")
            if not category or not category.replace("_", "a").isalnum():
                raise ValueError(f"category must be letters, digits and underscores: {category!r}")
            if re.compile(pattern, re.IGNORECASE).search("") is not None:
                raise ValueError(f"pattern matches the empty text: {pattern}")

    @cached_property
    def categories(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(category for category, _, _ in self.rules))

    @cached_property
    def _places(self) -> dict[str, int]:
        return {category: i for i, category in enumerate(self.categories)}

    @property
    def mask_words(self) -> int:
        return -(-len(self.categories) // MASK_BITS)

    def bit(self, category: str) -> int:
        return 1 << self._places[category]

    def mask(self, categories) -> int:
        """Mask of the given categories; those without a rule cannot occur and add nothing."""
        return sum(self.bit(c) for c in set(categories) if c in self._places)

    def weight(self, category: str) -> float:
        return self.weights.get(category, config.DEFAULT_WEIGHT)

    @cached_property
    def anchors(self) -> tuple[tuple[str, ...] | None, ...]:
        """Per rule, words of which every match holds at least one; None when not known.

        No word of the catalog holds another one: a longer word gives way to the shorter.
        """
        found = [_required_words(pattern) for _, _, pattern in self.rules]
        words = sorted({w for anchor in found for w in anchor or ()}, key=len)
        shortest: list[str] = []
        for word in words:
            if not any(short in word for short in shortest):
                shortest.append(word)
        return tuple(
            anchor and tuple(sorted({s for s in shortest for w in anchor if s in w})) for anchor in found
        )

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(i, c, s, p) for i, (c, s, p) in enumerate(self.rules)]
        return spark.createDataFrame(rows, "rule_id INT, category STRING, severity INT, pattern STRING")

    def weights_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.weights.items()), "category STRING, weight DOUBLE")

    def pairs_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.pairs), "cat_a STRING, cat_b STRING, bonus DOUBLE")


def _required_words(pattern: str) -> tuple[str, ...] | None:
    words = _sequence_words(_regex_parser.parse(pattern))
    return tuple(sorted(words)) if words and min(map(len, words)) >= 2 else None


def _sequence_words(sequence) -> set[str] | None:
    """The most selective word set among the parts that every match must contain."""
    found, run = [], ""
    for op, arg in [*sequence, (None, None)]:
        if str(op) == "LITERAL" and chr(arg).isascii():
            run += chr(arg).lower()
            continue
        if run:
            found.append({run})
            run = ""
        if str(op) == "SUBPATTERN":
            found.append(_sequence_words(arg[-1]))
        elif str(op) == "MAX_REPEAT" and arg[0] >= 1:
            found.append(_sequence_words(arg[-1]))
        elif str(op) == "BRANCH":
            branches = [_sequence_words(branch) for branch in arg[1]]
            found.append(set().union(*branches) if all(branches) else None)
    found = [words for words in found if words]
    return max(found, key=_selectivity, default=None)


def _selectivity(words: set[str]) -> tuple[int, int]:
    return min(1 if w in FREQUENT else len(w) for w in words), -len(words)


DEFAULT = Catalog(tuple(config.RULES))
