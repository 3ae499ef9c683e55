import random

import pytest
from pyspark.sql import functions as F

from chatrisk.operators import contacts, messages
from chatrisk.operators.contacts import WindowParams

GOLDEN = [
    ("external", "good evening, nice team photo on the wall", 0.05), ("child", "thx", 0.01),
    ("external", "age is just a number", 0.41), ("external", "you promised", 0.22),
    ("child", "maybe", 0.02), ("external", "are you home alone?", 0.64),
    ("external", "how old are you?", 0.35), ("child", "twelve", 0.02),
    ("external", "send me a pic", 0.91), ("child", "no", 0.02),
]


def window(spark, rows, params=WindowParams(), keys=("contact_id",), **options):
    """rows of (contact, sender, text, prob) in order."""
    data = [(c, i, s, t, p) for i, (c, s, t, p) in enumerate(rows)]
    df = spark.createDataFrame(data, "contact_id INT, seq INT, sender STRING, text STRING, ml_prob DOUBLE")
    return contacts.with_window(messages.annotate_contacts(df), list(keys), ["seq"], params, **options)


def test_golden_conversation(spark):
    scored = window(spark, [(1, *m) for m in GOLDEN])
    rows = scored.orderBy("seq").collect()
    # weights: age gap 1, coercion 2, meeting 1.5, age probing 0.5, images 2.5
    assert [r.score for r in rows] == [0, 0, 1, 3, 3, 7.5, 8, 8, 15.5, 15.5]
    last = rows[-1]
    assert (last.base, last.cooccur, last.escal, last.arc, last.consec) == (7.5, 1.5, 3, 3.5, 0)
    raised = contacts.alerts(scored).orderBy("seq").collect()
    assert [(r.seq, r.level) for r in raised] == [(3, "Medium"), (5, "Critical"), (6, "High"), (8, "Critical")]
    assert raised[3].signals == {"ESC": "yes", "ARC": "yes"}


@pytest.mark.parametrize("size, runs", [(1, [0] * 7), (2, [0] * 7), (3, [0, 0, 1, 1, 0, 0, 0]), (4, [0, 0, 1, 1, 1, 0, 0])])
def test_short_windows(spark, size, runs):
    senders = ["external"] * 4 + ["child"] * 3
    rows = window(spark, [(1, s, "hello", None) for s in senders], WindowParams(size=size)).orderBy("seq").collect()
    assert [r.n_runs for r in rows] == runs
    assert {(r.high_risk_count, r.risky_count) for r in rows} == {(0, 0)}  # no probability is no risk


def test_benign_run_scores_once(spark):
    rows = window(spark, [(1, "external", "hello there", 0.0)] * 7).orderBy("seq").collect()
    assert [r.score for r in rows] == [0, 0, 0.5, 0.5, 0.5, 0.5, 0.5]


def test_run_cut_by_the_frame_start_counts_its_visible_part(spark):
    senders = ["external"] * 4 + ["child"] * 3
    rows = window(spark, [(1, s, "hello", 0.0) for s in senders], WindowParams(size=5)).orderBy("seq").collect()
    # Frames end with: EEE, EEEE, EEEEC, EEECC, EECCC
    assert [r.n_runs for r in rows] == [0, 0, 1, 1, 1, 1, 0]


@pytest.mark.parametrize("rows, level, reason", [
    ([("send me a pic", 0.0)], "Critical", "Explicit grooming indicator | cats=[image_solicitation]"),
    ([("hi", 0.80)] * 3, "High", "High-confidence ML (3 msgs >= 0.8) | score=0.5 | cats=[none]"),
    ([("hi", 0.0), ("send me a pic", 0.0), ("send me a pic", 0.0), ("send me a pic", 0.0), ("hi", 0.0)], "High",
     "Window risk=8.0 >= 6.0 | cats=[image_solicitation]"),  # base 7.5, run 0.5; the early half already has severity 3
    ([("hi", 0.0), ("hi", 0.0), ("send me a pic", 0.0), ("send me a pic", 0.0), ("hi", 0.0)], "High",
     "Window risk=10.0 >= 6.0 | cats=[image_solicitation] | ESCALATION"),  # base 5.0, escalation 4.5, run 0.5
    ([("hi", 0.60)] * 5, "Medium", "Sustained pattern (5 msgs, score=0.5) | cats=[none]"),
    ([("age is just a number", 0.0)] * 3, "Medium", "Window risk=3.5 >= 2.5 | cats=[age_gap_minimization]"),
])
def test_each_branch_of_the_cascade(spark, rows, level, reason):
    scored = window(spark, [(1, "external", t, p) for t, p in rows])
    last = contacts.alerts(scored).orderBy(F.desc("seq")).first()
    assert (last.level, last.reason) == (level, reason)


def test_child_messages_raise_nothing(spark):
    assert contacts.alerts(window(spark, [(1, "child", "send me a pic", 1.0)] * 9)).count() == 0


def by_definition(rows, size):
    """(window_len, n_runs, risky) per message, straight from the last `size` messages."""
    out, seen = [], {}
    for contact, sender, _, prob in rows:
        frame = seen.setdefault(contact, [])
        frame.append((sender == "external", prob))
        last = frame[-size:]
        pattern = "".join("E" if e else "c" for e, _ in last)
        runs = sum(len(run) >= 3 for run in pattern.split("c"))
        out.append((len(last), runs, sum(e and p >= 0.6 for e, p in last)))
    return out


@pytest.mark.parametrize("size", [5, 30])
def test_pieces_of_a_hot_contact_equal_the_whole(spark, size):
    random.seed(size)
    texts = ["hi", "send me a pic", "age is just a number", "you promised", "let's meet up", "don't tell your mom"]
    rows = [(1 if random.random() < 0.7 else random.randint(2, 9), random.choice(["external", "external", "child"]),
             random.choice(texts), random.random()) for _ in range(900)]
    rows = [(c, s, t if s == "external" else "ok", p) for c, s, t, p in rows]
    whole = window(spark, rows, WindowParams(size=size)).drop("matches")
    pieces = window(spark, rows, WindowParams(size=size), piece_rows=64).drop("matches")
    assert whole.exceptAll(pieces).count() == 0 and pieces.count() == len(rows)
    assert [(r.window_len, r.n_runs) for r in whole.orderBy("seq").collect()] == [x[:2] for x in by_definition(rows, size)]


def test_window_of_a_new_conversation_starts_empty(spark):
    rows = window(spark, [(1, "external", "hi", 0.9)] * 4 + [(2, "external", "hi", 0.9)] * 2).orderBy("seq").collect()
    assert [r.window_len for r in rows] == [1, 2, 3, 4, 1, 2]
