"""Personal data: strict formats, wide generators and boosted trees, with DataFrame operations only.

Strict matches (e-mail, IP address, card and phone numbers that pass their checks) are always spans. Generators
with high recall propose further, overlapping candidates outside of them: written-out e-mail addresses, groups
of digits, dotted and dashed numbers, colon-separated addresses. Strict matches, passing (1)
or failing (0), and candidates (0) are added up into cells of format and context features; boosted trees are
fitted to the cells and compiled into SQL. A threshold calibrated on the cells selects the candidates that
look like what passes, and of overlapping ones the best.

Texts are scanned whole; null and empty ones have no span. Rows are independent, so repeated ids and ties
need no rule beyond the order of spans (start, kind, end). An empty table gives an empty result and an
untrained model, which selects nothing. Columns of the input give way to results of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatrisk.llm.boosting import Trees, fit

KINDS = ("email", "ip", "card", "phone")
#: Leftmost matches without backtracking into a run: `(?<!x)|\G` only skips starts that cannot match.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Candidates: (name, kind, pattern, what the text must hold). Every match is of bounded length.
GENERATORS = (
    ("written", "email",
     r"(?i)[A-Z0-9._%+-]{1,64}(?:@| ?[\[(]at[\])] ?| at )[A-Z0-9-]{1,64}(?:(?:\.| ?[\[(]dot[\])] ?| dot )[A-Z0-9-]{1,64}){1,4}", r"(?i)@|\bat\b"),
    ("digits", "phone", r"(?<![0-9A-Za-z])[(+]?[0-9][0-9 ().-]{5,30}[0-9](?![0-9A-Za-z])", "[0-9]"),
    ("dashed", "phone", r"(?<![0-9])[0-9]{2,4}[-.][0-9]{2,4}[-.][0-9]{2,5}(?![0-9])", "[0-9]"),
    ("colons", "ip", r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){4,7}(?![0-9A-Fa-f:])", ":"),
)
FEATURES = ("kind", "digits", "groups", "joint", "cue", "left", "right")
CUES = (
    ("against", r"(?i)(order|ticket|ref|invoice|version|article|isbn|item|no|nr)[.:# ]*$"),
    ("phone", r"(?i)(tel|phone|telephone|telefon|call|mobile|fax|whatsapp|sms)[a-z.]*[.:# ]*$"),
    ("card", r"(?i)(card|visa|mastercard|amex|credit|karte|carte|tarjeta)[a-z]*[.:# ]*$"),
    ("mail", r"(?i)(mail|contact|write|reach)[a-z.]*[.:# ]*$"),
    ("address", r"(?i)(ip|host|server|address)[a-z.]*[.:# ]*$"),
)
CONTEXT = 24
#: Share of passing matches that every selected score must have.
PRECISION = 0.8
_PIECE = 256


@dataclass
class Model:
    trees: Trees
    threshold: float


def running_sum(values: Column) -> Column:
    """Inclusive running sums of an array, in pieces so that the work stays near its length."""
    pieces = F.transform(
        F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _PIECE).cast("int"))),
        lambda i: F.slice(values, i * _PIECE + 1, _PIECE),
    )
    zero, none = F.lit(0).cast("bigint"), F.array().cast("array<bigint>")

    def scan(array: Column, start: Column) -> Column:
        step = lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.array_append(s["out"], s["sum"] + x).alias("out"))
        return F.aggregate(array, F.struct(start.alias("sum"), none.alias("out")), step, lambda s: s["out"])

    totals = scan(F.transform(pieces, lambda p: F.aggregate(p, zero, lambda a, x: a + x)), zero)
    return F.when(F.size(values) <= _PIECE, scan(values, zero)).otherwise(
        F.flatten(F.zip_with(pieces, F.concat(F.array(zero), totals), lambda p, t: F.when(p.isNotNull(), scan(p, t)).otherwise(none)))
    )


def _found(df: DataFrame, text: str, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """Arrays `_m_name` of matches (start, end, word, left, right) for each pattern."""
    none = F.array().cast("array<string>")

    def steps(n: str) -> Column:
        before = lambda i: F.when(i > 0, F.length(F.get(f"_w_{n}", i - 1))).otherwise(F.lit(0))
        return F.transform(f"_w_{n}", lambda w, i: (F.length(F.get(f"_g_{n}", i)) + before(i)).cast("bigint"))

    staged = df.withColumns({
        **{f"_w_{n}": F.when(need, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for n, (p, need) in patterns.items()},
        **{f"_g_{n}": F.when(need, F.split(text, p, -1)).otherwise(none) for n, (p, need) in patterns.items()},
    }).withColumns({
        f"_s_{n}": steps(n) for n in patterns
    }).withColumns({f"_e_{n}": running_sum(F.col(f"_s_{n}")) for n in patterns})

    def match(n: str) -> Column:
        return F.transform(f"_w_{n}", lambda w, i: F.struct(
            F.get(f"_e_{n}", i).alias("start"), (F.get(f"_e_{n}", i) + F.length(w)).alias("end"), w.alias("word"),
            F.right(F.get(f"_g_{n}", i), F.lit(CONTEXT)).alias("left"), F.left(F.get(f"_g_{n}", i + 1), F.lit(1)).alias("right"),
        ))

    drop = [f"_{x}_{n}" for n in patterns for x in "wgse"]
    return staged.withColumns({f"_m_{n}": match(n) for n in patterns}).drop(*drop)


def _passes(kind: str, word: Column) -> Column:
    digits = F.regexp_replace(word, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return word.rlike(f"^{part}\\.{part}\\.{part}\\.{part}$")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    turned = F.reverse(digits)
    one = lambda i: F.substr(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    sums = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: one(i) - F.when(one(i) > 9, 9).otherwise(0))
    return F.when(F.length(digits).between(12, 19), F.aggregate(sums, F.lit(0), lambda a, x: a + x) % 10 == 0).otherwise(F.lit(False))


def _rank(kind: str, word: Column, is_open: bool) -> Column:
    """The place of the kind in KINDS; open groups of 12 digits and more are cards."""
    if is_open and kind == "phone":
        return F.when(F.length(F.regexp_replace(word, "[^0-9]", "")) < 12, KINDS.index("phone")).otherwise(KINDS.index("card"))
    return F.lit(KINDS.index(kind))


def _features(rank: Column, m: Column) -> list[Column]:
    """Whole-number features of a match; each has a few values."""
    word = m["word"]
    digits = F.length(F.regexp_replace(word, "[^0-9]", ""))
    joints = F.length(F.regexp_replace(word, "[A-Za-z0-9]+", "x")) - F.length(F.regexp_replace(F.regexp_replace(word, "[A-Za-z0-9]+", "x"), "x", ""))
    cue = F.lit(0)
    for i, (_, pattern) in enumerate(CUES):
        cue = F.when(m["left"].rlike(pattern), F.lit(i + 1)).otherwise(cue)
    near = lambda c: F.when(c == "", 0).when(c.rlike("[\\s]$"), 1).when(c.rlike("[A-Za-z0-9]$"), 2).otherwise(3)
    values = [
        rank,
        F.when(digits < 7, 0).when(digits < 9, 1).when(digits < 12, 2).when(digits < 16, 3).when(digits < 17, 4).otherwise(5),
        F.least(joints, F.lit(5)),
        F.when(word.rlike("[(]"), 3).when(word.rlike("[.]"), 2).when(word.rlike("[ -]"), 1).otherwise(0),
        cue, near(m["left"]), near(m["right"]),
    ]
    return [v.cast("int").alias(n) for n, v in zip(FEATURES, values)]


def find(docs: DataFrame) -> DataFrame:
    """`docs` with base (passing strict spans: kind, start, end) and proposals.

    proposals holds strict matches that fail and candidates, each with its features and whether it may be
    selected; strict matches that pass are there too, for training.
    """
    own = [c for c in docs.columns if c not in ("base", "proposals")]
    text = docs.select(*own).withColumn("_t", F.coalesce("text", F.lit("")))
    digit = F.col("_t").rlike("[0-9]")
    strict = {
        k: (p, F.contains("_t", F.lit(NEEDS[k])) & (digit if k != "email" else F.lit(True))) for k, p in STRICT.items()
    }
    found = _found(text, "_t", strict)

    found = _found(found, "_t", {n: (p, F.col("_t").rlike(need)) for n, _, p, need in GENERATORS})

    def rated(name: str, kind: str, is_open: bool) -> Column:
        return F.transform(f"_m_{name}", lambda m: F.struct(
            m["start"].alias("start"), _rank(kind, m["word"], is_open).alias("rank"), m["end"].alias("end"),
            F.lit(is_open).alias("open"), (F.lit(False) if is_open else _passes(kind, m["word"])).alias("passes"),
            F.struct(*_features(_rank(kind, m["word"], is_open), m)).alias("f"),
        ))

    rows = [rated(k, k, False) for k in KINDS] + [rated(n, k, True) for n, k, _, _ in GENERATORS]
    found = found.withColumn("_all", F.sort_array(F.concat(*rows)))
    # A candidate that touches a base span is none. Matches are short, so neighbours in order of start do.
    touched = lambda p, i: F.exists(
        F.slice("_all", F.greatest(i - 31, F.lit(1)), 64), lambda q: q["passes"] & (q["start"] < p["end"]) & (p["start"] < q["end"])
    )
    base = F.transform(F.filter("_all", lambda p: p["passes"]), lambda p: F.struct(p["start"], p["rank"], p["end"]))
    return found.select(
        *own, base.alias("base"), F.filter("_all", lambda p, i: ~(p["open"] & touched(p, i))).alias("proposals")
    )


def train(found: DataFrame, precision: float = PRECISION) -> Model:
    """Trees fitted to the cells of all proposals, and the least score down to which enough pass at every score.

    Write `found` to a table first where it is used again: the proposals are then made once.
    """
    cells = (
        found.select(F.explode("proposals").alias("p")).select("p.f.*", F.col("p.passes").cast("int").alias("passes"))
        .groupBy(*FEATURES).agg(F.count(F.lit(1)).alias("n"), F.sum("passes").alias("ones")).orderBy(*FEATURES).collect()
    )
    table = np.array([[r[f] for f in FEATURES] for r in cells], int).reshape(-1, len(FEATURES))
    n, ones = np.array([r["n"] for r in cells], float), np.array([r["ones"] for r in cells], float)
    trees = fit(list(FEATURES), table, n, ones)
    scores = 1 / (1 + np.exp(-trees.margin(table)))
    threshold = 1.1
    for score in np.unique(scores)[::-1]:
        if ones[scores == score].sum() < precision * n[scores == score].sum():
            break
        threshold = float(score)
    return Model(trees, threshold)


def selected(found: DataFrame, model: Model) -> DataFrame:
    """`found` with spans (start, rank, end; sorted) in place of its proposals: base spans and selected candidates."""
    score = F.expr(f"transform(proposals, p -> struct(p.start, p.rank, p.end, p.open, {model.trees.sql('p.f.')} AS score))")
    open_ones = F.filter("_scored", lambda p: p["open"] & (p["score"] >= model.threshold - 1e-9))
    staged = found.withColumn("_scored", score).withColumn("_open", F.sort_array(open_ones))
    # Candidates are of bounded length, so only near neighbours in order of start can overlap: one that meets none before it
    # starts a cluster. In a cluster, by score, longest and first, a candidate is chosen unless it meets one already chosen.
    starts = F.filter(F.transform("_open", lambda p, i: F.when(~F.exists(
        F.slice("_open", F.greatest(i - 63, F.lit(1)), F.least(i, F.lit(64))), lambda q: q["end"] > p["start"]), i + 1)), lambda i: i.isNotNull())
    staged = staged.withColumn("_starts", starts)
    ranked = lambda cluster: F.sort_array(F.transform(cluster, lambda p: F.struct(
        (-p["score"]).alias("score"), (p["start"] - p["end"]).alias("size"), p["start"].alias("start"), p["rank"].alias("rank"), p["end"].alias("end"))))
    chosen = lambda rows: F.aggregate(rows, F.slice(rows, 1, 0), lambda kept, p: F.when(
        F.exists(kept, lambda q: (q["start"] < p["end"]) & (p["start"] < q["end"])), kept).otherwise(F.concat(kept, F.array(p))))
    clusters = F.transform("_starts", lambda at, j: ranked(F.slice(
        "_open", at, F.coalesce(F.get("_starts", j + 1), F.size("_open") + 1) - at)))
    staged = staged.withColumn("_clusters", clusters)
    best = F.flatten(F.transform("_clusters", chosen))
    added = F.transform(best, lambda p: F.struct(p["start"].alias("start"), p["rank"].alias("rank"), p["end"].alias("end")))
    names = [c for c in found.columns if c not in ("proposals", "spans")]
    return staged.select(*names, F.array_distinct(F.sort_array(F.concat("base", added))).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def with_digest(chosen: DataFrame) -> DataFrame:
    """n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, and all spans as text."""
    count = lambda i: F.size(F.filter("base", lambda s: s["rank"] == i)).cast("bigint")
    counts = {f"n_{k}": count(i) for i, k in enumerate(KINDS)}
    names = [c for c in chosen.columns if c not in ("base", "spans", "base_sha256", *counts)]
    return chosen.select(
        *names, *[v.alias(n) for n, v in counts.items()], F.sha2(listed("base"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )


def redacted(chosen: DataFrame) -> DataFrame:
    """`chosen` with every span of its texts replaced by the kind of the first span there, as [EMAIL]."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(s: Column, span: Column) -> Column:
        gap = F.substr("text", (s["at"] + 1).cast("int"), (span["start"] - s["at"]).cast("int"))
        return F.when(span["start"] < s["at"], F.struct(F.greatest(s["at"], span["end"]).alias("at"), s["out"].alias("out"))).otherwise(
            F.struct(span["end"].alias("at"), F.concat(s["out"], F.array(gap, F.get(names, span["rank"]))).alias("out"))
        )

    finish = lambda s: F.concat(F.array_join(s["out"], ""), F.substr("text", (s["at"] + 1).cast("int")))
    text = F.when(F.size("spans") > 0, F.aggregate("spans", start, step, finish)).otherwise(F.col("text"))
    return chosen.withColumn("text", text)
