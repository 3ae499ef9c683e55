"""Odd rows for the operators on texts: nulls, empty and long texts, repeated rows, clashing columns, empty tables."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatrisk.llm import boosting, chat, context_mixing, decontaminate, licenses, pii, quality, token_counts, toxicity

SCHEMA = "doc_id bigint, text string, n_words string, spans string, score string, matches string, kept string"
LONG = "lorem ipsum dolor 4111 1111 1111 1111 " * 20_000
TEXTS = [None, "", " \n ", "a b c", "a b c", LONG, "Zwölf Boxkämpfer jagen Viktor quer über den Sylter Deich"]


@pytest.fixture(scope="module")
def docs(session):
    return session.createDataFrame([(i % 5, t, "x", "x", "x", "x", "x") for i, t in enumerate(TEXTS)], SCHEMA)


def none(docs):
    return docs.filter("doc_id > 100")


def test_decontamination(session, docs):
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short, item!"), (3, None), (4, "...")]
    bench = session.createDataFrame(items, "item_id bigint, text string")
    hit = "x ONE two; three four five six seven eight nine TEN y short é item short item"
    rows = docs.unionByName(session.createDataFrame([(50, hit, *"xxxxx")], SCHEMA))
    for size in (1 << 20, 20):  # one pass, and several
        found = decontaminate.find_contamination(rows, bench, pass_bytes=size)
        row = decontaminate.with_digest(found).filter("doc_id = 50").first()
        assert (row.n_words, row.n_hit, row.hit_items) == (17, 12, [1, 2])
    assert [tuple(s) for s in row.hit_spans] == [(1, 11), (15, 17)]
    assert found.count() == len(TEXTS) + 1
    left = decontaminate.remove_spans(found, drop_share=0.9)
    assert left.filter("doc_id = 50").first().text == "x \n y short é item \n"
    assert decontaminate.remove_spans(found).filter("doc_id = 50").count() == 0
    assert decontaminate.find_contamination(none(docs), bench).count() == 0


def test_quality(docs):
    rows = quality.judged(docs).collect()
    assert [r.n_words for r in sorted(rows, key=lambda r: r.n_words)] == [0, 0, 0, 3, 3, 9, 140_000]
    long = max(rows, key=lambda r: r.n_words)
    assert long.n_repeat_words == 140_000 and long.base_failed and not long.kept
    assert quality.judged(none(docs)).count() == 0


def test_personal_data(session, docs):
    text = "Mail é a.b@c.de, +1 (555) 123-4567; 1.2.3.4 and 300.1.1.1 or 4111-1111-1111-1111"
    rows = docs.unionByName(session.createDataFrame([(50, text, *"xxxxx")], SCHEMA))
    found = pii.find(rows)
    chosen = pii.selected(found, pii.Model(boosting.Trees(list(pii.FEATURES)), 1.1))
    row = pii.with_digest(chosen).filter("doc_id = 50").first()
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1)
    cut = [text[int(a):int(b)] for _, a, b in (s.split(":") for s in row.spans.split(","))]
    assert cut == ["a.b@c.de", "+1 (555) 123-4567", "1.2.3.4", "4111-1111-1111-1111"]
    assert pii.redacted(chosen).filter("doc_id = 50").first().text == "Mail é [EMAIL], [PHONE]; [IP] and 300.1.1.1 or [CARD]"
    assert pii.redacted(pii.selected(pii.find(none(docs)), pii.train(pii.find(none(docs))))).count() == 0


def test_boosted_trees_equal_their_sql(session):
    rng = np.random.default_rng(3)
    cells = rng.integers(0, 4, (200, 2))
    ones = ((cells[:, 0] > 1) ^ (cells[:, 1] > 2)).astype(float)
    model = boosting.fit(["a", "b"], cells, np.ones(200), ones)
    p = 1 / (1 + np.exp(-model.margin(cells)))
    assert ((p > 0.5) == (ones == 1)).all()
    rows = session.createDataFrame([tuple(map(int, c)) for c in cells], "a int, b int").select(F.expr(model.sql()).alias("p")).collect()
    assert [r.p for r in rows] == pytest.approx(p.tolist())


def test_toxicity_grammar():
    grammar = toxicity.Clauses({b"lowei*": 4.0})
    score = lambda text: sum(grammar.scores(text.encode()))
    assert score("an ordinary day") == 0 and score("idiot") > 0
    assert score("you are an idiot") > score("idiot") > score("she said idiot") > 0
    assert score("not an idiot") < score("idiot") and score("i will kill you") <= score("you i will kill")
    assert score("kill") == 0 and score("loweichen") == 4.0
    assert len(grammar.scores(b"idiot. idiot! fine; moron")) == 3


def test_toxicity_without_labels(session, docs):
    labels = session.createDataFrame([], "doc_id bigint, toxic int")
    rows = toxicity.scored(docs, labels, lambda i: i % 5 == 0).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score < 0.5 and r.predicted == 0 for r in rows)


def test_templates():
    match = lambda template, text: licenses.compiled("x", template).match(text.split() and [w.encode() for w in text.split()], 0)
    assert match("a [[b]] c", "a c d") == 2 and match("a [[b]] c", "a b c") == 3 and match("a [[b]] c", "a x c") == -1
    assert match("a {{2}} c", "a c") == 2 and match("a {{2}} c", "a x y c") == 4 and match("a {{2}} c", "a x y z c") == -1


def test_license_scan(session, docs):
    text = "All rights, reserved. CC-BY 4.0; under the MIT License, General Public License version 3"
    rows = docs.unionByName(session.createDataFrame([(50, text, *"xxxxx")], SCHEMA))
    row = licenses.with_digest(licenses.scanned(rows)).filter("doc_id = 50").first()
    assert (row.n_base, row.first_word, row.last_word) == (3, 0, 11)
    assert row.base_labels == "cc-by,gpl,reserved" and set(row.labels.split(",")) >= {"mit", "gpl-3.0"}
    plain = licenses.with_digest(licenses.scanned(docs)).collect()
    assert len(plain) == len(TEXTS) and all((r.n_base, r.first_word, r.labels, r.score) == (0, None, "", 0.0) for r in plain)


def test_token_counts_equal_plain_dynamic_programming(docs):
    pieces = dict(token_counts.read_vocabulary(token_counts.VOCABULARY))

    def plain(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            best.append(max((best[s][0] + pieces[word[s:end]], best[s][1] - 1) for s in range(end) if word[s:end] in pieces))
        return -best[-1][1]

    want = Counter()
    for i, text in enumerate(TEXTS):
        tokens = token_counts.pre_tokens((text or "").encode())
        known = {t: plain(t) for t in set(tokens)}
        want[i % 5, len(tokens), len((text or "").encode()), sum(known[t] for t in tokens)] += 1
    got = Counter((r.doc_id, r.n_pre_tokens, r.n_bytes, r.n_tokens) for r in token_counts.counted(docs).collect())
    assert got == want


def test_context_mixing(session, docs):
    rows = context_mixing.scored(docs, slot_bits=(12, 12, 12, 12, 12)).collect()
    assert len(rows) == len(TEXTS)
    counts = Counter()
    for i, t in enumerate(TEXTS):
        if context_mixing.is_training(i % 5):
            counts.update(context_mixing.text_tokens((t or "").encode()))
    total, kinds = sum(counts.values()), len(counts)
    want = sorted(
        round(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in context_mixing.text_tokens((t or "").encode())), 6)
        for t in TEXTS
    )
    assert sorted(round(r.base_score, 6) for r in rows) == pytest.approx(want)
    assert all(r.score < 0 and r.train_tokens == total for r in rows)
    assert context_mixing.scored(none(docs), slot_bits=(12, 12, 12, 12, 12)).count() == 0


def test_probabilities_of_the_next_byte_sum_to_one():
    counts = [np.abs(np.random.default_rng(i).normal(size=(1 << 10, 2))).astype(np.float32) for i in range(5)]
    mixer = context_mixing.Mixer(counts)
    first = [10 ** (mixer.log10([bytes([b])], np.zeros(1))[0]) for b in range(256) if b != 32]
    # A one-byte word is that byte and its end: at most the first byte's probability, which all sum to one.
    assert 0 < sum(first) < 1


def test_every_significant_arc_counts(session):
    # 20 rare words, each in 24 toxic texts only; the shared bound lies far below their number.
    rows = [(i, f"wort{i % 20:02d}x du" if i < 480 else f"gut{i} du") for i in range(960)]
    docs = session.createDataFrame(rows, "doc_id bigint, text string")
    arcs = toxicity.learned_arcs(docs.select("text", (F.col("doc_id") < 480).cast("int").alias("toxic")))
    assert arcs.count() >= 20
    shared, joined = (
        {r.doc_id: (r.top, r.total) for r in toxicity.clause_sums(docs, arcs, ["doc_id"], shared=most).collect()} for most in (10_000, 7))
    assert shared == joined and all(joined[i][0] > 0 for i in range(480)) and not any(joined[i][0] for i in range(480, 960))


def test_candidates_are_chosen_greedily(session):
    def proposal(start, end, kind):
        return (start, 3, end, True, False, (kind, 0, 0, 0, 0, 0, 0))

    # A (0-10) meets B (8-20), B meets C (18-30), A does not meet C: scores fall from A to C. D stands alone.
    chain = [proposal(0, 10, 0), proposal(8, 20, 1), proposal(18, 30, 2), proposal(40, 50, 2)]
    schema = ("doc_id bigint, base array<struct<start bigint, rank int, end bigint>>, proposals array<struct<start bigint, rank int, end bigint, "
              "open boolean, passes boolean, f struct<%s>>>" % ", ".join(f"{n}: int" for n in pii.FEATURES))
    found = session.createDataFrame([(1, [], chain), (2, [], []), (3, [], chain[1:3]), (4, [], chain[::2] + chain[2:3])], schema)
    trees = boosting.Trees(list(pii.FEATURES), 0.0, [((0, 0), ((0, 9), 3.0, 3.0), ((0, 1), 2.0, 1.0))])
    rows = pii.selected(found, pii.Model(trees, 0.0)).collect()
    assert {r.doc_id: [(s.start, s.end) for s in r.spans] for r in rows} == {
        1: [(0, 10), (18, 30), (40, 50)], 2: [], 3: [(8, 20)], 4: [(0, 10), (18, 30)]}


def test_chat_is_read_back(session):
    rows = [
        (1, 0, "user", "a & b <|im_end|> &lt;|"), (1, 1, "user", "second"), (1, 2, "assistant", "x\ny"), (1, 3, None, None),
        (1, None, "sys<|\ntem", "first"), (None, 0, "user", "lone"), *[(9, i, "assistant", f"t{i}") for i in range(600)],
        (1, 2, "assistant", "x\ny"),
    ]
    out = {r.conv_id: r for r in chat.formatted(session.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
           .withColumn("turns", chat.read_turns(F.col("formatted"))).collect()}
    assert [tuple(t) for t in out[1].turns] == [
        ("sys<|\ntem", "first"), ("user", "a & b <|im_end|> &lt;|"), ("user", "second"), ("assistant", "x\ny"), ("assistant", "x\ny"), ("", ""),
    ]
    assert out[1].formatted.count(chat.START) == 4 and out[9].formatted.count(chat.START) == 1
    assert [t.text for t in out[9].turns] == [f"t{i}" for i in range(600)] and len(out) == 3
    assert re.sub(r"<\|im_(start|sep|end)\|>", "", out[1].formatted).count("<|") == 0
