"""The parts of the risk score as SQL expressions over counts, masks and message ordinals.

An ordinal numbers the scored messages (flagged authors, external senders) of one conversation or
window from 1. `first_k`/`last_k` are the lowest and highest ordinal with severity k or more; with
them "the early half reaches severity k" is `first_k <= half`, so no list of messages is needed.
The catalog's two dozen categories make these expressions long, hence text and not column objects.
"""

from __future__ import annotations

from collections.abc import Callable

from chatrisk import config
from chatrisk.functions.catalog import MASK_BITS, Catalog

SEVERITIES = (1, 2, 3)


def word_name(mask: str, word: int) -> str:
    """The column of a mask's word; the first one has the mask's own name."""
    return mask if word == 0 else f"{mask}_{word}"


def word_names(mask: str, catalog: Catalog) -> list[str]:
    return [word_name(mask, word) for word in range(catalog.mask_words)]


def mask_parts(mask: str, wanted: int) -> list[tuple[str, int]]:
    """(column, bits) of the words of `mask` that the number `wanted` has bits in."""
    parts = []
    for word in range(-(-wanted.bit_length() // MASK_BITS)):
        bits = wanted >> word * MASK_BITS & (1 << MASK_BITS) - 1
        if bits:
            parts.append((word_name(mask, word), bits))
    return parts


def has_any(mask: str, wanted: int) -> str:
    tests = [f"({column} & {bits}L) != 0" for column, bits in mask_parts(mask, wanted)]
    return f"({' OR '.join(tests)})" if len(tests) > 1 else "".join(tests) or "false"


def has_all(mask: str, wanted: int) -> str:
    return "(" + " AND ".join(f"({column} & {bits}L) = {bits}L" for column, bits in mask_parts(mask, wanted)) + ")"


def is_empty(mask: str, catalog: Catalog) -> str:
    return "(" + " AND ".join(f"{column} = 0" for column in word_names(mask, catalog)) + ")"


def has_several(mask: str, catalog: Catalog) -> str:
    """Two categories or more."""
    if catalog.mask_words == 1:
        return f"({mask} & ({mask} - 1L)) != 0"
    return " + ".join(f"bit_count({column})" for column in word_names(mask, catalog)) + " > 1"


def base_score(count_of: Callable[[str], str], mask: str, catalog: Catalog) -> str:
    """Sum of weight times count, each category's count capped; most masks are empty."""
    terms = " + ".join(
        f"{catalog.weight(c)}D * least({count_of(c)}, {config.COUNT_CAP})" for c in catalog.categories)
    return f"IF({is_empty(mask, catalog)}, 0D, {terms})"


def pair_score(mask: str, catalog: Catalog) -> str:
    """Sum of the bonuses of all pairs whose two categories are both present."""
    terms = [
        f"IF({has_all(mask, both)}, {bonus}D, 0D)"
        for both, bonus in ((catalog.mask([a, b]), bonus) for a, b, bonus in catalog.pairs
                            if a in catalog.categories and b in catalog.categories)
    ]
    return f"IF({has_several(mask, catalog)}, {' + '.join(['0D', *terms])}, 0D)"


def _highest(reached: Callable[[int], str]) -> str:
    """Highest severity k for which `reached(k)` holds, else 0."""
    whens = " ".join(f"WHEN {reached(k)} THEN {k}" for k in reversed(SEVERITIES))
    return f"(CASE {whens} ELSE 0 END)"


def escalation(n: str, first: Callable[[int], str], last: Callable[[int], str]) -> str:
    """Bonus when the later half of n messages is more severe than the earlier half."""
    early = _highest(lambda k: f"{first(k)} <= {n} div 2")
    late = _highest(lambda k: f"{last(k)} > {n} div 2")
    return (
        f"CASE WHEN {n} >= {config.ESCALATION_MIN_MESSAGES} AND {late} > {early} THEN {config.ESCALATION_BONUS}D + "
        f"IF({early} <= 1 AND {late} = 3, {config.ESCALATION_JUMP_BONUS}D, 0D) ELSE 0D END"
    )


def stage_arc(n: str, first_trust: str, last_solicit: str, mask: str, catalog: Catalog) -> str:
    """Bonus for trust building in the first third and solicitation in the last third."""
    third = f"greatest({n} div 3, 1)"
    return (
        f"CASE WHEN {n} >= {config.ARC_MIN_MESSAGES} AND {first_trust} <= {third} AND {last_solicit} > {n} - {third} "
        f"THEN {config.ARC_BONUS}D + IF({has_any(mask, catalog.mask(catalog.control))}, {config.ARC_CONTROL_BONUS}D, 0D) "
        f"ELSE 0D END"
    )


def level_of(score: str) -> str:
    return f"CASE WHEN {score} >= {config.RISK_HIGH}D THEN 'HIGH' WHEN {score} >= {config.RISK_MEDIUM}D THEN 'MEDIUM' ELSE 'LOW' END"
