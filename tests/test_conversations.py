import random

import pytest
from pyspark.sql import functions as F

from chatrisk.operators import conversations, datasets, messages, records, reports
from chatrisk.operators.conversations import COMPONENTS
from chatrisk.sources import corpus
from test_contacts import GOLDEN


def table(spark, conversations_):
    """{conv: [(flagged, text), ...]} to annotated messages."""
    rows = [(c, i, "x" if f else "y", t, f) for c, ms in conversations_.items() for i, (f, t) in enumerate(ms)]
    return messages.annotate_messages(
        spark.createDataFrame(rows, "conv_id STRING, conv_idx INT, author STRING, text_raw STRING, is_flagged BOOLEAN"))


def test_golden_scores(spark):
    rows = table(spark, {
        "g1": [(s == "external", t) for s, t, _ in GOLDEN],
        "g2": [(True, "send me a pic, don't tell your parents"), (False, "idk")],
        "g4": [(True, "a"), (True, "b"), (True, "  "), (True, "c"), (False, "d"), (False, "e")],
        "run": [(True, "a"), (True, "b"), (True, "c"), (True, "d"), (False, "x"), (False, "x"), (False, "y")],
        "none": [(False, "send me a pic")],
    })
    risk = {r.conv_id: r for r in conversations.conversation_risk(rows).collect()}
    assert (risk["g1"].score, risk["g1"].level, risk["g1"].dominance, risk["g1"].density) == (15.5, "HIGH", 0, 0)
    assert [risk["g2"][c] for c in COMPONENTS] == [4.5, 1.5, 0, 0, 0, 2, 0] and risk["g2"].score == 8.0
    assert risk["g4"].consec == 0.0 and risk["run"].consec == 0.5
    assert (risk["none"].score, risk["none"].level, risk["none"].label) == (0.0, "LOW", 0)


def test_golden_text(spark):
    rows = table(spark, {"g2": [(True, "send me a pic, don't tell your parents"), (False, "idk")], "blank": [(True, " ")]})
    texts = {r.conversation_id: r for r in datasets.annotated_texts(rows).collect()}
    assert texts["g2"].text == (
        "[RISK:HIGH] [CATS:image_solicitation,isolation] [ESC:0] [ARC:0] [DOM:0] [PRED] [RULE:isolation:3] "
        "[RULE:image_solicitation:3] send me a picture, don't tell your parents [SEP] [USER] i do not know")
    assert texts["blank"].text == "[RISK:LOW] [CATS:none] [ESC:0] [ARC:0] [DOM:0]" and texts["blank"].label == 1


@pytest.fixture(scope="module")
def chat(spark):
    random.seed(3)
    phrases = ["hi", " ", "send me a pic", "age is just a number", "you promised", "don't tell your mom", "how old are you"]
    data = {f"c{k}": [(random.random() < 0.7, random.choice(phrases)) for _ in range(n)] for k, n in enumerate([900, 1, 7, 60, 61, 300, 5])}
    return table(spark, data).cache()


def test_pieces_of_a_hot_conversation_equal_the_whole(chat):
    whole, pieces = conversations.conversation_risk(chat), conversations.conversation_risk(chat, piece_rows=32)
    assert whole.exceptAll(pieces.select(whole.columns)).count() == 0 and pieces.count() == 7


def test_parts_join_to_the_whole_text(chat):
    whole = {r.conversation_id: r.text for r in datasets.annotated_texts(chat).collect()}
    parts = datasets.annotated_texts(chat, piece_rows=32).orderBy("conversation_id", "part").collect()
    joined = {}
    for row in parts:
        joined.setdefault(row.conversation_id, []).append(row.text)
        assert row.n_parts == len([p for p in parts if p.conversation_id == row.conversation_id])
    assert {k: " [SEP] ".join(v) for k, v in joined.items()} == whole


def test_records_of_several_parts_equal_the_whole(chat):
    one = records.slim_records(datasets.dataset_columns(datasets.annotated_texts(chat)))
    many = records.slim_records(datasets.dataset_columns(datasets.annotated_texts(chat, piece_rows=32)))
    flat = lambda df: sorted((r.conversation_id, r.risk_level, r.escalation, r.arc, r.dominance, r.categories, sorted(r.cat_counts.items()),
                              r.total_rule_hits, r.sev3_hits, r.n_messages, r.label) for r in df.collect())
    assert flat(one) == flat(many)


def test_round_trip_of_tags(spark, chat):
    dataset = datasets.annotated_texts(chat)
    parsed = {r.conversation_id: r for r in records.parse_records(datasets.dataset_columns(dataset)).collect()}
    for row in dataset.collect():
        back = parsed[row.conversation_id]
        assert (back.risk_level, back.categories) == (row.level, row.categories)
        assert (back.escalation, back.arc, back.dominance) == (row.escal > 0, row.arc > 0, row.dominance > 0)


def test_record_without_prefix(spark):
    rows = spark.createDataFrame([("a", "[PRED] [RULE:x:3] [RULE:x:2] hi [SEP] [USER] yo [SEP]  ", 0)], "conversation_id STRING, text STRING, label INT")
    r = records.parse_records(rows).first()
    assert (r.risk_level, r.risk_order, r.categories, r.cat_counts, r.sev3_hits, r.n_messages) == ("UNKNOWN", 0, [], {"x": 2}, 1, 2)
    assert (r.messages[0].role, r.messages[0].text, r.label_str) == ("PRED", "hi", "benign")


def test_scope_all_says_nothing_about_flags(spark):
    plain = {"a": [(True, "send me a pic"), (False, "you promised"), (True, "hi")]}
    swapped = {"a": [(not f, t) for f, t in plain["a"]]}
    texts = []
    for data in (plain, swapped):
        rows = table(spark, data).select("conv_id", "conv_idx", "author", "text_raw", "is_flagged")
        annotated = messages.annotate_messages(rows, scope="all")
        texts.append(datasets.annotated_texts(annotated, scope="all").first().text)
    assert texts[0] == texts[1]


@pytest.mark.parametrize("n, ratio", [(10, 0.1), (997, 0.1), (1, 0.1), (50, 0.5), (3, 0.0)])
def test_exact_split_shares(spark, n, ratio):
    rows = spark.range(n).select(F.col("id").cast("string").alias("conversation_id"), (F.col("id") % 7 == 0).cast("int").alias("label"))
    split = datasets.split_exact(rows, ratio=ratio)
    counts = {(r.label, r.split): r.n for r in split.groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    for label in (0, 1):
        size = counts.get((label, "val"), 0) + counts.get((label, "train"), 0)
        assert counts.get((label, "val"), 0) == int(size * ratio + 0.5)
    assert split.count() == n and split.exceptAll(datasets.split_exact(rows, ratio=ratio)).count() == 0


def test_ranked_report_spread_over_partitions_equals_one_task(spark, chat):
    slim = records.slim_records(datasets.dataset_columns(datasets.annotated_texts(chat)))
    one = [tuple(r) for r in reports.ranked_report(slim).select("idx", "conversation_id").orderBy("idx").collect()]
    many = [tuple(r) for r in reports.ranked_report(slim, piece_rows=2).select("idx", "conversation_id").orderBy("idx").collect()]
    assert one == many and [i for i, _ in one] == list(range(1, 8))


def test_adding_a_hit_never_lowers_base_and_pairs(spark):
    base = [(True, "hi"), (True, "send me a pic")]
    risk = {r.conv_id: r for r in conversations.conversation_risk(table(spark, {"a": base, "b": [*base, (True, "don't tell your mom")]})).collect()}
    assert risk["b"].base >= risk["a"].base and risk["b"].cooccur >= risk["a"].cooccur


def test_records_do_not_depend_on_the_piece_length(spark, chat, tmp_path):
    blank = table(spark, {"late": [(True, " ")] * 40 + [(True, "send me a pic"), (False, "hi")], "none": [(True, " ")] * 70})
    rows = chat.unionByName(blank.select(chat.columns))
    outs = []
    for piece_rows in (1 << 17, 32):
        made = datasets.dataset_columns(datasets.annotated_texts(rows, piece_rows=piece_rows)).cache()
        path = str(tmp_path / str(piece_rows))
        datasets.split_by_hash(made).write.json(path)
        parsed = records.parse_records(made)
        texts = reports.ranked_report(parsed).select("conversation_id", "n_messages", reports.readable_text().alias("text"))
        outs.append([sorted(map(tuple, df.collect())) for df in (
            datasets.whole_texts(made), corpus.read_records(spark, path, lines=True), texts,
            reports.ranked_report(parsed).select("idx", "conversation_id", "risk_level", "messages"))])
    assert made.count() > 9 and all(len(rows) == 9 for rows in outs[0])
    assert outs[0] == outs[1]


def test_lines_of_parts_equal_the_whole_text(chat):
    """The report by lines, from parts that are never joined, is the report by rows."""
    whole = datasets.dataset_columns(datasets.annotated_texts(chat))
    rows = reports.ranked_report(records.parse_records(whole)).orderBy("idx").select(reports.readable_text().alias("t")).collect()
    parts = datasets.dataset_columns(datasets.annotated_texts(chat, piece_rows=32))
    lines = reports.readable_lines(reports.ranked_report(records.slim_records(parts)), records.parsed_parts(parts))
    found = [r.value for r in lines.orderBy("idx", "part", "at").collect()]
    assert found == [line for r in rows for line in r.t.split("\n")]
