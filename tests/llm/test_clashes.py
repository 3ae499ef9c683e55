"""Input columns with the names of results, and labels that are neither 0 nor 1."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from chatrisk.llm import boosting, decontaminate, licenses, mixing, pii, toxicity

TEXT = "write to a.b@c.de or +49 151 2345678, one two three four five six seven eight nine ten, cc by, all rights reserved"


def clashing(table, names, source=False):
    docs = table([(1, TEXT, "s"), (2, None, None)], "doc_id bigint, text string, source string")
    return docs.withColumns({n: F.lit("clash") for n in names})


def one_of_each(df):
    assert len(df.columns) == len(set(df.columns))
    return {r["doc_id"]: r for r in df.collect()}


def test_license_columns(table):
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
    out = one_of_each(licenses.with_digest(licenses.scanned(clashing(table, names))))
    assert (out[1].n_base, out[1].base_labels) == (2, "cc-by,reserved") and out[2].n_base == 0


def test_personal_data_columns(table):
    names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "base", "proposals"]
    found = pii.find(clashing(table, names))
    out = one_of_each(pii.with_digest(pii.selected(found, pii.train(found))))
    assert (out[1].n_email, out[1].n_phone, out[2].n_email) == (1, 1, 0)


def test_decontamination_columns(table):
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans", "hit_items"]
    bench = table([(7, "ONE two three four five six seven eight nine ten")], "item_id bigint, text string")
    out = one_of_each(decontaminate.with_digest(decontaminate.find_contamination(clashing(table, names), bench)))
    assert (out[1].n_hit, out[1].n_items, out[1].contaminated, out[2].contaminated) == (10, 1, True, False)


def test_mixing_columns(table):
    names = ["size", "source_size", "target", "copies", "taken"]
    out = one_of_each(mixing.mixed(clashing(table, names)))
    assert out[1]["size"] == len(TEXT.split()) and out[2].taken == 0


@pytest.mark.parametrize("others", [[2, -1, None, 7], []])
def test_odd_labels_teach_nothing(session, others):
    random.seed(4)
    rows = [(k, " ".join(random.choices(["plain", "word", "lowei", "text"], k=20))) for k in range(60)]
    docs = session.createDataFrame(rows, "doc_id bigint, text string")
    plain = [(k, int("lowei lowei" in t)) for k, t in rows]
    odd = [(k, other) for k in range(60) for other in others]
    score = lambda labels: {r.doc_id: r.score for r in toxicity.scored(
        docs, session.createDataFrame(labels, "doc_id bigint, toxic int"), lambda i: i % 5 == 0).collect()}
    assert score(plain + odd) == score(plain)


def plain_base(text):
    """The base spans by the definitions, one kind after the other."""
    def luhn(digits):
        turned = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
        return sum(x - 9 * (x > 9) for x in turned) % 10 == 0

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda w, d: True),
        ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", lambda w, d: all(int(p) <= 255 for p in w.split("."))),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", lambda w, d: 12 <= len(d) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda w, d: 9 <= len(d) <= 15),
    ]
    found = [(m.start(), rank, m.end()) for rank, (_, pattern, fits) in enumerate(kinds)
             for m in re.finditer(pattern, text or "") if fits(m[0], re.sub("[^0-9]", "", m[0]))]
    return ",".join(f"{kinds[rank][0]}:{start}:{end}" for start, rank, end in sorted(found))


def test_base_spans_equal_the_definitions(session):
    random.seed(6)
    parts = ["4111 1111 1111 1111", "4111111111111112", "+1 (212) 555-0100", "+12", "10.0.0.255", "1.2.3.256", "1.2.3.4.5", "a@b.c", "a.b+c@d-e.f.gh.",
             "é", "😀", "x", "12-34", "0000000000000", "+49.30.1234567", "@", "a@b", "\n", "00.01.002.0003", "5500-0000-0000-0004-1"]
    rows = [(k, random.choice(["", " ", "-"]).join(random.choices(parts, k=random.randint(1, 12)))) for k in range(300)] + [(900, None), (901, "")]
    found = pii.find(session.createDataFrame(rows, "doc_id bigint, text string"))
    chosen = pii.selected(found, pii.Model(boosting.Trees(list(pii.FEATURES)), 1.1))
    out = {r.doc_id: r.b for r in chosen.select("doc_id", pii.listed("base").alias("b")).collect()}
    assert out == {k: plain_base(t) for k, t in rows}


def test_base_phrases_equal_the_definitions(session):
    random.seed(9)
    words = "cc by CC-BY general public License all Rights reserved é x 9".split()
    rows = [(k, random.choice([" ", ", ", "\n"]).join(random.choices(words, k=random.randint(0, 40)))) for k in range(200)] + [(900, None)]
    phrases = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
    out = {r.doc_id: r for r in licenses.with_digest(licenses.scanned(session.createDataFrame(rows, "doc_id bigint, text string"))).collect()}
    for k, text in rows:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        hits = [(i, label) for phrase, label in phrases for i in range(len(own)) if own[i : i + len(phrase.split())] == phrase.split()]
        starts, r = [i for i, _ in hits], out[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(own), len(hits), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in hits})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))


def test_expected_copies_meet_the_target_for_any_weights(session):
    """The level of a source: what full classes cannot take goes to the others."""
    random.seed(12)
    for _ in range(6):
        sizes = {w: random.randint(1, 500) for w in random.sample([0.5, 1.0, 2.0, 3.0, 8.0], random.randint(1, 5))}
        target = random.uniform(0.1, 3.0) * sum(sizes.values())
        rows = session.createDataFrame([("s", w, n, target) for w, n in sizes.items()], "k string, _own double, _size bigint, target double")
        level = mixing._levels(rows, ["k"], 3).first()["_level"]
        assert math.isclose(sum(n * min(3.0, level * w) for w, n in sizes.items()), target, rel_tol=1e-9)
