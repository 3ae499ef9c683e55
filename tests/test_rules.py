import random
import re
from collections import Counter

import pytest

from pyspark.sql import functions as F

from chatrisk import config, views
from chatrisk.functions import rules
from chatrisk.functions.catalog import DEFAULT, Catalog

PHRASES = [
    *views.SINGLE, *views.DOUBLE, views.BENIGN, "", "don’t tell your mom", "DON'T TELL YOUR MOM",
    "ſend me a pic", "i ſhowed you mine", "KEEP thıs a secret", "rate my pics photos nudes boobs", "photos", "send send me a photo photo",
    "alone", "are you home alone on fridays", "never mind your parents, don't tell your mom what we planned",
    "one pic each, what are you wearing", "age is just a number they say, and we could meet up",
    "how old are you? how old are you? don't tell your parents, you promised",
    "nude nude nude", "what school do you go to, and when do you walk home", "ünderstand you better than your family",
    "would you date someone older, let’s meet up", "éage is just a number",
]


def by_hand(text: str, catalog: Catalog = DEFAULT) -> list:
    """Every occurrence of every pattern, by Python's own regex engine."""
    return [
        (i, c, s, *m.span(), m.group())
        for i, (c, s, p) in enumerate(catalog.rules) for m in re.finditer(p, text, re.IGNORECASE)
    ]


def test_catalog_counts():
    assert len(DEFAULT.rules) == 119 and len(DEFAULT.categories) == 22
    assert Counter(s for _, s, _ in DEFAULT.rules) == {3: 48, 2: 66, 1: 5}
    assert len(DEFAULT.pairs) == 21 and set(DEFAULT.weights) == set(DEFAULT.categories)
    assert all(DEFAULT.anchors)


@pytest.mark.parametrize("gate", [True, False])
def test_hits_and_spans_equal_python(spark, gate):
    rows = spark.createDataFrame([(p,) for p in PHRASES], "text STRING")
    for row in rules.with_matches(rows, spans=True, gate=gate).collect():
        assert [tuple(m) for m in row.matches] == by_hand(row.text), row.text


def test_gate_never_changes_hits_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    found = rules.with_matches(docs).collect()
    assert [[tuple(m) for m in r.matches] for r in found] == [[(i, c, s, t) for i, c, s, _, _, t in by_hand(r.text)] for r in found]


def test_summary(spark):
    rows = spark.createDataFrame([("send me a pic, don't tell your parents",), ("hello",), (None,)], "text STRING")
    a, b, c = rules.with_summary(rules.with_matches(rows)).withColumn("cats", rules.categories()).collect()
    assert (a.max_severity, a.n_hits, a.critical, a.cats) == (3, 2, True, ["image_solicitation", "isolation"])
    assert a.cat_mask == DEFAULT.mask(["isolation", "image_solicitation"])
    assert (b.max_severity, b.n_hits, b.critical, b.cats, b.cat_mask) == (0, 0, False, [], 0)
    assert c.n_hits == 0


def test_custom_catalog_without_required_words(spark):
    catalog = Catalog((("digits", 2, r"\d+"), ("digits", 3, r"[ab]c"), ("word", 1, r"\bxyz\b")))
    assert catalog.anchors[0] is None
    rows = spark.createDataFrame([("12 ac 3 xyz",)], "text STRING")
    assert [tuple(m) for m in rules.with_matches(rows, catalog=catalog, spans=True).first().matches] == by_hand("12 ac 3 xyz", catalog)


@pytest.mark.parametrize("bad", [(), (("a", 4, "x"),), (("a", 1, "x*"),), (("a b", 1, "x"),)])
def test_bad_catalogs_are_refused(bad):
    with pytest.raises(ValueError):
        Catalog(bad)


def test_any_number_of_categories_is_taken():
    many = Catalog(tuple((f"c{i}", 1, "x") for i in range(64)))
    assert many.mask_words == 2 and Catalog(many.rules[:63]).mask_words == 1 and many.mask(["c63"]) == 1 << 63


def test_unknown_category_weighs_one():
    assert Catalog((("other", 1, "x"),)).weight("other") == config.DEFAULT_WEIGHT


def test_masks_of_several_words(spark):
    """150 categories, in three words: a message's categories, counts and pairs do not depend on the word they are in."""
    from chatrisk.functions.scoring import has_all, has_any, is_empty, mask_parts

    many = Catalog(tuple((f"c{k}", 1, rf"\bw{k}\b") for k in range(150)), pairs=(("c1", "c149", 1.0),), trust=("c140",), solicit=(), control=())
    assert many.mask_words == 3 and mask_parts("m", many.mask(["c0", "c63", "c149"])) == [("m", 1), ("m_1", 1), ("m_2", 1 << 23)]
    rows = spark.createDataFrame([("w0 w62",), ("w63 w125 w126",), ("w149 x w1 w64",), ("none",)], "text STRING")
    found = rules.with_summary(rules.with_matches(rows, "text", many), many).select(
        rules.mask_categories("cat_mask", many).alias("cats"), F.expr(has_any("cat_mask", many.mask(["c149", "c62"]))).alias("any"),
        F.expr(has_all("cat_mask", many.mask(["c149", "c1"]))).alias("pair"), F.expr(is_empty("cat_mask", many)).alias("empty"),
        F.expr(has_any("cat_mask", 0)).alias("nothing"))
    assert [tuple(r) for r in found.collect()] == [
        (["c0", "c62"], True, False, False, False), (["c125", "c126", "c63"], False, False, False, False),
        (["c1", "c149", "c64"], True, True, False, False), ([], False, False, True, False)]


def test_spans_of_texts_that_hold_the_marks(spark):
    """Places are counted in characters, whatever stands between the hits, the marks used for counting included."""
    catalog = Catalog((("a", 1, r"\bsex\b"), ("b", 2, r"x+y?")))
    texts = ["sexy sex sex", "﷐x﷑xy﷒ sex﷓", "😀 xx é x", "", "none"]
    df = rules.with_matches(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, text STRING"), "text", catalog, spans=True, gate=False)
    found = sorted((r.i, r.rule_id, r.start, r.end, r.text) for r in rules.explode_hits(df, "i").collect())
    wanted = sorted((i, k, m.start(), m.end(), m[0]) for i, t in enumerate(texts) for k, (_, _, p) in enumerate(catalog.rules) for m in re.finditer(p, t))
    assert found == wanted


def test_a_catalog_as_a_table_equals_the_unrolled_form(spark):
    """The fixed rules, rules without required words and rules in other orders, on phrases and odd texts."""
    from chatrisk.functions import catalog_table

    more = (("any", 1, r"\d{2,}"), ("any", 2, r"[aeiou]{3,}|zz"), ("tail", 3, r"(alone|home)\W*$"))
    catalog = Catalog((*DEFAULT.rules, *more))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*PHRASES, None, "queue 12 345 jazz", "K İ ı ſ"])], "i INT, text STRING")
    unrolled = rules.with_matches(rows, "text", catalog).select("i", "matches")
    table = catalog_table.read_catalog(catalog.to_df(spark).orderBy(F.desc("rule_id")))
    found = catalog_table.with_table_matches(rows, table).select("i", "matches")
    assert sorted(map(str, found.collect())) == sorted(map(str, unrolled.collect()))
    none = catalog_table.with_table_matches(rows, table, when=F.col("i") < 0)
    assert none.filter(F.size("matches") > 0).count() == 0
    assert catalog_table.with_table_matches(rows, catalog_table.RuleTable.of([])).filter(F.size("matches") > 0).count() == 0


def test_plain_rules_of_a_table_hit_as_in_the_unrolled_form(spark):
    """Rules that begin alike, overlap, end in nothing or are not plain, on plain and other texts; the session's engine
    gets only what is not plain."""
    from chatrisk.functions import catalog_table

    patterns = [rf"\b{w}{rest}" for w in ("you", "ana", "it") for rest in (
        "", r"\b", r"\b.{3}", r".{1,4}", r"\s+\w{2}\b", r"\b.*", r"\b.*?t", "(r|rs)?", r"\w*\W", r"[a-f ]+", "[^a-c]{2}", "$", r"\D+\d", "?s")]
    patterns += [r"a.a\ba\.a", "ana", "ana.{2}", "an(a|t)", r"\d+", r"(it|you)\s\w+", "don['\u2019]t", "(?=you).", "(an)+a", "a++n", "[a-z&&[^b]]{3}", r"you(?<=ou)\b", "it\\Z"]
    catalog = Catalog(tuple((f"c{k % 7}", 1 + k % 3, p) for k, p in enumerate(p for p in patterns if "&&" not in p)))
    letters = random.Random(7)
    parts = ["you", "YOU", "ana", "banana", "anana", "it", "its", "yours", " ", "  ", "\t", "don\u2019t", "\u00dcber", "7", "x9", "?", "-", "fab", "\u0416", "_"]
    odd = ["\n", "\r", "\u0130t", "\u0131t", "\x1c", "\u00a0", "e\u0301", "\u00b2", "\U0001f600", "\u4e2d", "\u2028"]
    plain = ["".join(letters.choices(parts, k=letters.randint(1, 12))) for _ in range(400)]
    others = ["".join(letters.choices(parts + 2 * odd, k=12)) for _ in range(200)]
    texts = spark.createDataFrame(list(enumerate([*plain, *others])), "i INT, text STRING")
    table = catalog_table.read_catalog(catalog.to_df(spark))
    found = {r.i: r.matches for r in catalog_table.with_table_matches(texts, table).select("i", "matches").collect()}
    assert found == {r.i: r.matches for r in rules.with_matches(texts, "text", catalog, gate=False).select("i", "matches").collect()}
    left = {r["rule_id"] for rest in catalog_table._Automaton(table).found(plain).field("left").to_pylist() for r in rest}
    assert left and left <= {k for k, (_, _, p) in enumerate(catalog.rules) if p in ("(?=you).", "(an)+a", "a++n", r"you(?<=ou)\b", "it\\Z")}
    dotted = catalog_table.RuleTable.of([(0, "c", 1, r"a.a\b-?a\.a")])
    assert catalog_table._Automaton(dotted).found(["axa-a.a"]).field("hits").to_pylist() == [[{"rule_id": 0, "category": "c", "severity": 1, "text": "axa-a.a"}]]
    assert not catalog_table._is_plain("[a-z&&[^b]]{3}") and not any(map(catalog_table.PLAIN_TEXT.fullmatch, odd))


@pytest.mark.parametrize("rows", [[(1, "a", 4, "x")], [(1, "a", 1, "x*")], [(1, "a", 1, "x"), (1, "b", 1, "y")], [(1, "", 1, "x")], [(1, "a", 1, "(")]])
def test_bad_rule_tables(rows):
    from chatrisk.functions import catalog_table

    with pytest.raises((ValueError, re.error)):
        catalog_table.RuleTable.of(rows)


def test_texts_are_lowered_once(spark):
    """The lowered text is used twice, and computed in one place of the plan."""
    rows = rules.with_matches(spark.range(3).select(F.format_string("What SCHOOL %d", "id").alias("text")))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1
    assert [len(r.matches) for r in rows.collect()] == [len(rules_hit.matches) for rules_hit in rules.with_matches(rows.select("text"), gate=False).collect()]
