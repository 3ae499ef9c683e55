import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from chatrisk import config
from chatrisk.functions import text

SAMPLES = [
    "send me a pic, don't tell your parents", "idk", "ngl u r gr8", "NGL  that's   ok\tok\nkk", "", "   ", "1000 soooo....",
    "see https://x.example/a?b=c and www.y.example now", "mail me@x.example.org or ME+2@Y.io", "call 555-123-4567 or 12 34 56 78",
    "ﬁne Ａ①", "don’t k é u éu uè ü", "İstanbul K", "hey\x01u\x01r", "cause cuz r8 l8r rn wydrn", "a\n\n\n\nb", "ΑΣ ΟΔΟΣ", "u_u u-u u.u",
]


def expected(value: str, slang=config.SLANG) -> str:
    """The definition, one rule after the other."""
    value = unicodedata.normalize("NFKC", value).lower()
    for pattern, token in ((config.URL_PATTERN, "<URL>"), (config.EMAIL_PATTERN, "<EMAIL>"), (config.PHONE_PATTERN, "<PHONE>")):
        value = re.sub(pattern, token, value, flags=re.IGNORECASE)
    value = re.sub(r"(.)\1{2,}", r"\1\1", value)
    for word, meaning in slang:
        value = re.sub(rf"\b{re.escape(word)}\b", meaning, value, flags=re.IGNORECASE)
    return re.sub(r"\s+", " ", value).strip()


def test_normalise_equals_rule_by_rule(spark):
    rows = spark.createDataFrame(list(enumerate(SAMPLES)), "id INT, text_raw STRING")
    for row in text.normalise(rows).collect():
        assert row.norm == expected(row.text_raw), row.text_raw


def test_every_slang_word(spark):
    samples = [f"x {w} y" for w, _ in config.SLANG] + [f"{w}{v}" for (w, _), (v, _) in zip(config.SLANG, config.SLANG[1:])]
    rows = spark.createDataFrame([(s,) for s in samples], "text_raw STRING")
    for row in text.normalise(rows).collect():
        assert row.norm == expected(row.text_raw)


def test_slang_table_is_closed_under_its_cascade():
    assert len(config.SLANG) == 108
    assert text.closed_slang()["ngl"] == "not going to lie"
    assert text.closed_slang()["kk"] == "okay"


def test_nfkc_through_icu_equals_arrow(spark):
    rows = spark.createDataFrame([(s,) for s in SAMPLES], "t STRING")
    assert rows.select(text.nfkc(F.col("t"))).collect() == rows.select(text.nfkc_arrow(F.col("t"))).collect()


def test_empty_messages_are_dropped_after_normalisation(spark):
    rows = spark.createDataFrame([("a",), ("   ",), ("",), (None,)], "text_raw STRING")
    assert [r.norm for r in text.drop_empty(text.normalise(rows)).collect()] == ["a"]


def test_documents_equal_rule_by_rule(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    for row in text.normalise(docs, "text").collect():
        assert row.norm == expected(row.text)


@pytest.mark.parametrize("step", [text.mask_urls, text.mask_emails, text.collapse_repeats])
def test_steps_leave_plain_text_alone(spark, step):
    assert spark.createDataFrame([("plain words",)], "t STRING").select(step(F.col("t"))).first()[0] == "plain words"
