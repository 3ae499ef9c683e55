"""Gradient-boosted trees over cells: distinct combinations of small whole-number features with counts.

Spark adds up all rows into cells; their number is bounded by the product of the features' values, not by the
rows. Trees of two levels are fitted to the cells on the driver and compiled into a SQL expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    names: list[str]
    start: float = 0.0
    #: Per tree: (feature, cut), then the same and two leaf values for the left and the right half.
    trees: list[tuple] = field(default_factory=list)

    def margin(self, cells: np.ndarray) -> np.ndarray:
        total = np.full(len(cells), self.start)
        for (f, cut), *halves in self.trees:
            left = cells[:, f] <= cut
            for side, ((g, at), low, high) in zip((left, ~left), halves):
                total += np.where(side, np.where(cells[:, g] <= at, low, high), 0.0)
        return total

    def sql(self, prefix: str = "") -> str:
        """The probability as a SQL expression over columns `prefix`name."""
        names = [prefix + n for n in self.names]

        def half(node) -> str:
            (g, at), low, high = node
            return f"CASE WHEN {names[g]} <= {at} THEN {low!r}D ELSE {high!r}D END"

        terms = [f"CASE WHEN {names[f]} <= {cut} THEN {half(a)} ELSE {half(b)} END" for (f, cut), a, b in self.trees]
        return f"1 / (1 + exp(-({' + '.join([f'{self.start!r}D', *terms])})))"


def fit(names: list[str], cells: np.ndarray, n: np.ndarray, positive: np.ndarray, rounds: int = 30, rate: float = 0.3) -> Trees:
    """Trees that predict the share of positive rows of a cell, by logistic loss."""
    total, ones = n.sum(), positive.sum()
    model = Trees(list(names), float(np.log((ones + 0.5) / (total - ones + 0.5))))
    if not total or not 0 < ones < total:
        return model
    margin = model.margin(cells)
    cuts = [(f, int(c)) for f in range(len(names)) for c in np.unique(cells[:, f])[:-1]]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        push, pull = positive - n * p, n * p * (1 - p)
        top = _best(cells, cuts, push, pull, np.ones(len(cells), bool))
        if top is None:
            break
        left = cells[:, top[0]] <= top[1]
        halves = []
        for side in (left, ~left):
            at = _best(cells, cuts, push, pull, side) or top
            low = side & (cells[:, at[0]] <= at[1])
            halves.append((at, *(float(rate * push[s].sum() / (pull[s].sum() + 1)) for s in (low, side & ~low))))
        model.trees.append((top, *halves))
        margin = model.margin(cells)
    return model


def _best(cells, cuts, push, pull, within) -> tuple[int, int] | None:
    best, gain = None, 1e-9
    for f, c in cuts:
        left = within & (cells[:, f] <= c)
        right = within & ~left
        if not left.any() or not right.any():
            continue
        value = sum(push[s].sum() ** 2 / (pull[s].sum() + 1) for s in (left, right)) - push[within].sum() ** 2 / (pull[within].sum() + 1)
        if value > gain:
            best, gain = (f, c), value
    return best
