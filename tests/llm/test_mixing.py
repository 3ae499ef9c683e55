import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chatrisk.llm import mixing

SCHEMA = "doc_id bigint, source string, text string"


def shared_out(sizes, weights, most):
    """Targets by resharing the excess again and again; sizes in order of source."""
    total, full, targets = sum(sizes), set(), {}
    while True:
        rest = [i for i in range(len(sizes)) if i not in full]
        left = total - sum(most * sizes[i] for i in full)
        mass = sum(weights[i % len(weights)] for i in rest)
        targets = {i: most * sizes[i] if i in full else left * weights[i % len(weights)] / mass for i in range(len(sizes))}
        over = {i for i in rest if targets[i] > most * sizes[i] + 1e-9}
        if not over:
            return [targets[i] for i in range(len(sizes))]
        full |= over


@settings(max_examples=8, deadline=None)
@given(sizes=st.lists(st.integers(0, 500), min_size=1, max_size=12).filter(any))
def test_targets_equal_resharing(session, sizes):
    rows = [(f"s{i:02d}", n) for i, n in enumerate(sizes)]
    out = mixing.with_targets(session.createDataFrame(rows, "source string, source_size bigint")).collect()
    got = [r["target"] for r in sorted(out, key=lambda r: r["source"])]
    assert got == pytest.approx(shared_out(sizes, mixing.WEIGHTS, mixing.MOST_COPIES), abs=1e-6)


def test_taken_words_meet_the_target(table):
    rows = [(i, "a" if i % 3 else "b", " ".join(["w"] * (i % 17))) for i in range(600)] + [(1000, None, "x y")]
    mix = mixing.mixed(table(rows, SCHEMA)).collect()
    assert len(mix) == len(rows)
    for source in ("a", "b", None):
        own = [r for r in mix if r["source"] == source]
        taken = sum(r["taken"] for r in own)
        assert abs(taken - own[0]["target"]) <= max(r["size"] for r in own)
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert all(0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["copies"] for r in own)
    again = mixing.mixed(table(rows, SCHEMA)).collect()
    assert sorted(map(str, mix)) == sorted(map(str, again))


def test_weights_change_inclusion(table):
    rows = [(i, "a" if i < 400 else "b", "w w") for i in range(600)]
    docs = table(rows, SCHEMA).withColumn("w", F.when(F.col("doc_id") % 2 == 0, 1.5).otherwise(0.5))
    taken = {r["doc_id"]: r["copies"] for r in mixing.mixed(docs, weight=F.col("w")).filter("source = 'b'").collect()}
    even, odd = (sum(c for i, c in taken.items() if i % 2 == k) for k in (0, 1))
    assert even > 1.5 * odd


def test_odd_rows(table):
    rows = [(1, "a", None), (1, "a", None), (None, "a", ""), (2, None, " \t "), (2, None, "one two"), (3, "a", "w " * 50_000)]
    mix = mixing.mixed(table(rows, SCHEMA).withColumn("size", F.lit("clash")).withColumn("taken", F.lit(1)))
    out = mix.collect()
    assert sorted(r["size"] for r in out) == [0, 0, 0, 0, 2, 50_000]
    assert mixing.materialised(mix).count() == sum(r["copies"] for r in out)
    assert mixing.mixed(table([], SCHEMA)).count() == 0
