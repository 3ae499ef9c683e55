import json

import pytest
from pyspark.sql import functions as F

from chatrisk.operators import datasets, messages, records, reports
from chatrisk.sources import corpus, sinks

XML = """<?xml version="1.0" encoding="UTF-8"?>
<conversations>
<conversation id=" one "><message line="1"><author> a </author><time>10:00</time><text>hi &amp; bye</text></message>
<message line="2"><author>b</author><time>10:01</time><text/></message>
<message line="3"><time>10:02</time><text>42</text></message>
<message line="4"><author>a</author><time>10:03</time></message></conversation>
<conversation id="two"><message line="1"><author>c</author><time>x</time><text>
 two
 lines </text></message></conversation>
</conversations>
"""


def test_xml(spark, tmp_path):
    (tmp_path / "c.xml").write_text(XML, encoding="utf-8")
    rows = corpus.read_messages(spark, str(tmp_path / "c.xml")).orderBy("conv_id", "conv_idx").collect()
    assert [tuple(r) for r in rows] == [
        ("one", 0, "a", "hi & bye"), ("one", 1, "b", ""), ("one", 2, "", "42"), ("one", 3, "a", ""), ("two", 0, "c", "two\n lines")]


def test_authors_and_truth(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x1\n\n# note\n  x2  \nx1\n", encoding="utf-8")
    assert sorted(r[0] for r in corpus.read_authors(spark, str(tmp_path / "a.txt")).collect()) == ["x1", "x2"]
    (tmp_path / "t.txt").write_text("c1\ta1\nc1\ta1\nc2   a2\n#c9\ta9\nonlyone\nc3\ta3\textra\nc4 a4 more\nc5\t\tz\n", encoding="utf-8")
    truth = corpus.read_truth(spark, str(tmp_path / "t.txt"))
    assert sorted(tuple(r) for r in truth.collect()) == [("c1", "a1"), ("c2", "a2"), ("c3", "a3"), ("c4", "a4"), ("c5", "")]
    assert corpus.skipped_truth_lines(spark, str(tmp_path / "t.txt")).first()[0] == 1


def test_dataset_from_files_to_report(spark, tmp_path):
    (tmp_path / "c.xml").write_text(XML.replace("hi &amp; bye", "send me a pic"), encoding="utf-8")
    (tmp_path / "a.txt").write_text("a\n", encoding="utf-8")
    flagged = messages.flag_by_author(corpus.read_messages(spark, str(tmp_path / "c.xml")), corpus.read_authors(spark, str(tmp_path / "a.txt")))
    built = datasets.split_by_hash(datasets.build_dataset(flagged))
    sinks.write_dataset(built, str(tmp_path / "ds"))
    back = spark.read.parquet(str(tmp_path / "ds"))
    assert sorted((r.conversation_id, r.label, r.text) for r in back.collect()) == [
        ("one", 1, "[RISK:MEDIUM] [CATS:image_solicitation] [ESC:0] [ARC:0] [DOM:0] [PRED] [RULE:image_solicitation:3] send me a picture [SEP] [USER] 42"),
        ("two", 0, "[RISK:LOW] [CATS:none] [ESC:0] [ARC:0] [DOM:0] [USER] two lines")]
    ranked = reports.ranked_report(records.parse_records(back))
    sinks.write_readable(ranked, str(tmp_path / "readable"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "readable")).collect()]
    assert "#1  [GROOMING]  RISK:MEDIUM" in lines and "[PRED]  [image_solicitation:3]  send me a picture" in lines
    sinks.write_analysis(ranked, str(tmp_path / "analysis"))
    assert [r.conversation_id for r in spark.read.json(str(tmp_path / "analysis")).orderBy("idx").collect()] == ["one", "two"]


def test_records_from_a_json_array(spark, tmp_path):
    rows = [{"conversation_id": "a", "text": "é", "label": 1}, {"conversation_id": "b", "text": "x", "label": 0}]
    (tmp_path / "r.json").write_text(json.dumps(rows, ensure_ascii=False, indent=2), encoding="utf-8")
    assert sorted(tuple(r) for r in corpus.read_records(spark, str(tmp_path / "r.json")).collect()) == [("a", "é", 1), ("b", "x", 0)]


def test_truth_labels_the_conversation_of_the_pair_only(spark):
    rows = spark.createDataFrame([("c1", 0, "a", "x"), ("c2", 0, "a", "x")], "conv_id STRING, conv_idx INT, author STRING, text_raw STRING")
    truth = spark.createDataFrame([("c1", "a"), ("c1", "a"), ("c2", "b")], "conv_id STRING, author_id STRING")
    flagged = messages.flag_by_truth(rows, truth)
    assert {r.conv_id: r.label for r in messages.conversation_labels(flagged).collect()} == {"c1": 1, "c2": 0}


@pytest.mark.parametrize("hot", [1 << 17, 60, 1])
def test_lookup_beyond_the_limit_equals_broadcast(spark, hot):
    from chatrisk.plans.joins import lookup_join, semi_join

    key = F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.least(F.col("id") % 7, F.lit(4)))
    big = spark.range(500).select(key.alias("k"), "id")
    small = spark.createDataFrame([(1, "a"), (3, "b"), (4, "d"), (9, "c"), (None, "n")], "k BIGINT, v STRING")
    for how in ("left", "inner", "left_semi", "left_anti"):
        for null_safe in (False, True):
            one = lookup_join(big, small, ["k"], how, null_safe=null_safe)
            other = lookup_join(big, small, ["k"], how, limit=1, hot_rows=hot, null_safe=null_safe)
            assert one.columns == other.columns and one.count() == other.count() and one.exceptAll(other).count() == 0
    keys = small.select("k")
    kept, left = (semi_join(big, keys, ["k"], keep, limit=1) for keep in (True, False))
    assert kept.count() + left.count() == 500 and kept.filter("k IS NULL").count() == 46 and left.filter("k IS NULL").count() == 0


def test_hot_null_keys_are_placed(spark):
    from chatrisk.plans.skew import split_hot, with_position

    rows = spark.range(100).select(F.when(F.col("id") % 2 == 0, F.col("id") % 3).alias("k"), "id")
    placed = with_position(rows, ["k"], ["id"], limit=20)
    plain = with_position(rows, ["k"], ["id"])
    assert placed.count() == 100 and placed.select("k", "id", "pos").exceptAll(plain.select("k", "id", "pos")).count() == 0
    ordinary, hot = split_hot(rows, ["k"], 20)
    assert (ordinary.count(), hot.count()) == (50, 50) and hot.filter("k IS NOT NULL").count() == 0


def test_conversations_without_messages_stay(spark, tmp_path):
    empty = '<conversation id="none"></conversation><conversation id="bare"/></conversations>'
    (tmp_path / "c.xml").write_text(XML.replace("</conversations>", empty), encoding="utf-8")
    rows = corpus.read_messages(spark, str(tmp_path / "c.xml"))
    assert sorted(tuple(r) for r in rows.filter("conv_id IN ('none', 'bare')").collect()) == [("bare", 0, None, ""), ("none", 0, None, "")]
    authors = spark.createDataFrame([("a",)], "author_id STRING")
    built = {r.conversation_id: r for r in datasets.build_dataset(messages.flag_by_author(rows, authors)).collect()}
    assert {i: (built[i].label, built[i].text) for i in ("none", "bare")} == dict.fromkeys(
        ("none", "bare"), (0, "[RISK:LOW] [CATS:none] [ESC:0] [ARC:0] [DOM:0]"))


def test_a_long_conversation_keeps_its_id(spark, monkeypatch, tmp_path):
    from chatrisk.checks import queries

    rows = spark.range(100_005).select(
        F.lit("7").alias("conv_id"), F.col("id").cast("int").alias("conv_idx"), F.lit("a").alias("author"), F.col("id").cast("string").alias("text_raw"))
    monkeypatch.setattr(queries.views, "conversation_messages", lambda *_: rows)
    monkeypatch.setattr(queries, "scratch_path", lambda *_: str(tmp_path / "xml"))
    out = queries.QUERIES["xml_messages"](spark, "")
    assert out.select("conv_id", "conv_idx", F.col("text_raw").cast("int")).agg(
        F.countDistinct("conv_id"), F.count("*"), F.max("conv_idx"), F.count_if(F.col("conv_idx") != F.col("text_raw").cast("int"))
    ).first()[:] == (1, 100_005, 100_004, 0)


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def xml_file(path, conversations):
    lines = []
    for attributes, texts in conversations:
        body = "".join(f"<message line='1'><author>a&lt;{k}</author><text>{t}</text></message>\n" for k, t in enumerate(texts))
        lines.append(f"<conversation{attributes}>{body}</conversation>")
    path.write_text('<?xml version="1.0" encoding="UTF-8"?>\n<conversations>\n' + "\n".join(lines) + "\n</conversations>\n", encoding="utf-8")


def test_elements_stay_apart_over_many_splits(spark, tmp_path, small_splits):
    """Ids that repeat or are missing, empty elements, comments, character data, and one element over many splits."""
    texts = ["hi", "", "é &amp; ü" * 5, "<![CDATA[a <message> & b]]>", "x" * 400, " two\n lines "]
    plain = ["hi", "", "é & ü" * 5, "a <message> & b", "x" * 400, "two\n lines"]
    made = [(' id="same"', texts), (' id="same"', texts[:2]), ("", texts), (" id='q>1'", []), ("", []), (' id="long"', texts * 40),
            (' kind="x" id="last &amp; least"', texts), (' id="end"', [])]
    xml_file(tmp_path / "a.xml", made)
    (tmp_path / "b.xml").write_text('<conversations><!-- <conversation id="no"> --><conversation id="solo"/><conversation id="one"><message/><message line="2"><text>t</text></message></conversation></conversations>', encoding="utf-8")
    rows = corpus.read_elements(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() > 20
    found = {}
    for r in sorted(rows.collect(), key=lambda r: (r.conv_key, r.conv_idx)):
        found.setdefault(r.conv_key, []).append((r.conv_id, r.conv_idx, r.author, r.text_raw))
    ids = ["same", "same", "", "q>1", "", "long", "last & least", "end"]
    wanted = [[(i, k, f"a<{k}", plain[k % 6]) for k in range(len(t))] or [(i, 0, None, "")] for i, (_, t) in zip(ids, made)]
    wanted += [[("solo", 0, None, "")], [("one", 0, "", ""), ("one", 1, "", "t")]]
    assert sorted(found.values(), key=str) == sorted(wanted, key=str)


@pytest.mark.parametrize("text", [
    "<conversations><conversation id='a'><message><text>x</text></message>",
    "<conversations><conversation id='a'><message><text>x</text></message><message><text>y",
    "<conversations><message><text>x</text></message></conversations>",
    "<conversations><conversation id='a'><conversation id='b'></conversation></conversation></conversations>",
    "<conversations><conversation id='a'><message><text>x</message></conversation></conversations>",
    "<conversations><conversation id='a'></message></conversation></conversations>",
])
def test_malformed_elements_are_errors(spark, tmp_path, text):
    (tmp_path / "c.xml").write_text(text, encoding="utf-8")
    with pytest.raises(Exception, match="(?i)closed|outside|inside|malformed|end"):
        corpus.read_elements(spark, str(tmp_path / "c.xml")).collect()


@pytest.mark.parametrize("indent", [None, 2])
def test_json_arrays_are_split_at_record_ends(spark, tmp_path, small_splits, indent):
    texts = ['a}b', 'q"u{o', "\\", 'x\\"}', "[1]", "é}\n", '"', "", "{" * 40, "]}" * 400, "plain"]
    rows = [{"conversation_id": f"{k}", "text": texts[k % 11] * (1 + k % 3), "label": k % 2, "more": {"a": [k, {"b": "}"}]}} for k in range(300)]
    (tmp_path / "r.json").write_text(json.dumps(rows, ensure_ascii=False, indent=indent), encoding="utf-8")
    (tmp_path / "empty.json").write_text(" [ ]\n", encoding="utf-8")
    (tmp_path / "one.json").write_text('﻿[{"conversation_id": 7, "text": null}]', encoding="utf-8")
    found = corpus.read_array_records(spark, str(tmp_path)).select("conversation_id", "text", "label")
    assert found.rdd.getNumPartitions() > 20
    wanted = [(r["conversation_id"], r["text"], r["label"]) for r in rows] + [("7", None, None)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(wanted, key=str)


@pytest.mark.parametrize("text", [
    '[{"text": "a"}', '[{"text": "a"', '{"text": "a"}', '[{"text": "a"} {"text": "b"}]', '[{"text": "a"}] x', '[{"text": "a}]',
    '[1, 2]', '[{"text": }]', '[{"text": "a\\}"}]', '[{"text": "a"}]]', '[{"text": "a"},]',
])
def test_broken_arrays_are_errors(spark, tmp_path, text):
    (tmp_path / "r.json").write_text(text, encoding="utf-8")
    with pytest.raises(Exception):
        corpus.read_array_records(spark, str(tmp_path / "r.json")).collect()


def test_arrays_are_written_and_read_back(spark, tmp_path):
    rows = spark.range(50).select(F.col("id").cast("string").alias("conversation_id"), F.lit(0).alias("part"), F.lit(1).alias("n_parts"),
                                  F.concat(F.lit('"},{'), "id").alias("text"), F.lit(1).alias("label"), F.lit("train").alias("split"))
    sinks.write_json_array(rows.repartition(3), str(tmp_path / "ds"))
    assert spark.read.text(str(tmp_path / "ds" / "split=val")).filter("value <> ''").collect() in ([], [("[]",)])
    for file in (tmp_path / "ds" / "split=train").glob("part-*"):
        assert json.loads(file.read_text())
    back = corpus.read_array_records(spark, str(tmp_path / "ds" / "split=train"))
    assert back.count() == 50 and back.exceptAll(rows.drop("split")).count() == 0
