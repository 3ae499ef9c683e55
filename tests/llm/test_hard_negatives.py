import math
import random

import pytest
from pyspark.sql import functions as F

from chatrisk.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, label int, embedding array<float>"
ANCHOR = "vec_id % 10 = 0"


def mined(df, **options):
    rows = hn.prepared(df, F.col("vec_id"), F.col("label"), F.col("embedding"))
    return sorted(tuple(r) for r in hn.mined(rows, F.expr(ANCHOR), **options).collect())


def brute(rows, n_positives=5, n_negatives=10, low=30, high=90):
    own = {}
    for i, label, vector in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if i not in own or (label, vector) < own[i]:
            own[i] = (label, vector)
    whole = {i: (label, [math.floor(256 * x) for x in vector]) for i, (label, vector) in own.items()}
    out = []
    for a, (a_label, a_vector) in whole.items():
        if a % 10:
            continue
        score = {i: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a_vector, v)))) for i, (_, v) in whole.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if whole[i][0] == a_label][:n_positives]:
            fit = [i for i in order if whole[i][0] != a_label and low * score[p] <= 100 * score[i] <= high * score[p]]
            out += [(a, p, rank, i, score[p], score[i]) for rank, i in enumerate(fit[:n_negatives], 1)]
    return sorted(out)


def vectors(n=400, seed=1):
    random.seed(seed)
    rows = [(k, random.choice([0, 0, 1, 2]), [round(random.gauss(0.1, 0.3), 3) for _ in range(8)]) for k in range(n)]
    rows += [(1000 + k, 1, rows[7][2]) for k in range(40)] + [(2000 + k, 0, rows[7][2]) for k in range(40)]  # ties
    rows += [(3000, 0, [0.0] * 8), (3010, 1, [0.0] * 8), (3011, 1, [0.0] * 8), (-20, 0, [-1.0] * 8), (-21, 0, [1.0] * 8)]
    rows += [(4000, None, [1.0]), (4010, 1, None), (4020, 1, [1.0, None]), (4030, 1, [float("nan")] * 8), (4040, 1, [float("inf")] * 8)]
    rows += [(None, 1, [1.0] * 8), (5000, 2, []), (5010, 2, [2.0, 3.0]), (6000, 1, [0.5] * 8), (6000, 0, [0.25] * 8), (6000, 0, [0.5] * 8)]
    rows += [(7, *rows[7][1:])]
    as_float = lambda v: None if v is None else [None if x is None else float(__import__("numpy").float32(x)) for x in v]
    return [(i, label, as_float(v)) for i, label, v in rows]


@pytest.mark.parametrize("block", [1024, 16])
def test_equals_brute_force(table, block):
    rows = vectors()
    assert mined(table(rows, SCHEMA).repartition(5), block=block) == brute(rows)


def test_other_bounds_and_numbers(table):
    rows = vectors(200, 4)
    options = {"n_positives": 2, "n_negatives": 3, "low": 0, "high": 100}
    assert mined(table(rows, SCHEMA), block=32, **options) == brute(rows, **options)
    with pytest.raises(ValueError):
        mined(table(rows, SCHEMA), low=50, high=50)


def test_scores_beyond_double_precision_and_bigint(table):
    big = float(2**40)
    rows = [(0, 1, [big + 2**17, 3.0]), (1, 1, [big, -5.0]), (2, 0, [big / 2, 1.0]), (3, 0, [big / 2 + 2**16, 1.0]), (4, 2, [big / 4, 7.0])]
    assert mined(table(rows, SCHEMA)) == brute(rows)
    rows = [(i, label, [x * 2.0**40 for x in v]) for i, label, v in rows]
    assert mined(table(rows, SCHEMA)) == brute(rows)


def test_keys_sort_as_wanted():
    random.seed(2)
    ends = [-(2**63), -1, 0, 1, 2**63 - 1]
    parts = [(random.choice(ends), random.choice(ends), random.choice(ends), random.random() < 0.5) for _ in range(400)]
    by_key = sorted(parts, key=lambda p: hn.packed(*p))
    assert by_key == sorted(parts, key=lambda p: (p[0], -p[1], not p[3], p[2]))
    assert all(hn.unpacked(hn.packed(*p)) == p for p in parts)
    assert len({hn.spread_anchor(hn.packed(100 * k, 0, 0, False)) % 100 for k in range(1000)}) > 90


def test_nothing_to_mine(table):
    assert mined(table([], SCHEMA)) == []
    assert mined(table([(1, 1, [1.0]), (2, 0, [1.0])], SCHEMA)) == []
    assert mined(table([(0, 1, [1.0]), (2, 0, [1.0])], SCHEMA)) == []
    clash = table([(0, 1, [1.0], 1, "x"), (1, 1, [1.0], 2, "y"), (2, 0, [0.5], 3, "z")], SCHEMA + ", block int, ids string")
    assert mined(clash) == [(0, 1, 1, 2, 65536, 32768)]
