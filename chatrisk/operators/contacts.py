"""Sliding windows per contact: counts, window risk, alerts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatrisk import config
from chatrisk.functions import scoring
from chatrisk.functions.catalog import DEFAULT, Catalog
from chatrisk.functions.rules import mask_categories
from chatrisk.plans.skew import PIECE_ROWS, split_hot, spread_position, with_pieces

EXTERNAL = "external"


@dataclass(frozen=True)
class WindowParams:
    size: int = config.WINDOW_SIZE
    theta_high: float = config.THETA_HIGH
    theta_medium: float = config.THETA_MEDIUM
    high_count: int = config.HIGH_COUNT
    risky_count: int = config.RISKY_COUNT
    score_high: float = config.RISK_HIGH
    score_medium: float = config.RISK_MEDIUM

    def __post_init__(self):
        if self.size < 1:
            raise ValueError("the window needs at least one message")


class PackedCounts:
    """Category counts of a window packed into BIGINT fields, so that a few sums give them all.

    A count is at most the window size, so a field of that many bits cannot overflow.
    """

    def __init__(self, catalog: Catalog, size: int):
        self.bits = size.bit_length()
        self.per_word = 62 // self.bits
        self.categories = catalog.categories
        self.catalog = catalog
        self.words = -(-len(self.categories) // self.per_word)
        self.names = [f"_packed{w}" for w in range(self.words)]

    def contribution(self, mask: str, word: int) -> str:
        """What one message adds to a word."""
        fields = [
            f"IF({scoring.has_any(mask, self.catalog.bit(category))}, {1 << (slot * self.bits)}L, 0L)"
            for slot, category in enumerate(self._slots(word))
        ]
        return f"IF({scoring.is_empty(mask, self.catalog)}, 0L, {' + '.join(fields)})"

    def count_of(self, category: str) -> str:
        word, slot = divmod(self.categories.index(category), self.per_word)
        return f"(shiftright(_packed{word}, {slot * self.bits}) & {(1 << self.bits) - 1}L)"

    def present(self) -> str:
        """(category, n) of the categories that occur."""
        entries = ", ".join(
            f"named_struct('category', '{c}', 'n', CAST({self.count_of(c)} AS INT))" for c in self.categories)
        return f"filter(array({entries}), c -> c.n > 0)"

    def _slots(self, word: int) -> tuple[str, ...]:
        return self.categories[word * self.per_word:(word + 1) * self.per_word]


def is_risky(params: WindowParams = WindowParams()) -> Column:
    """A message with a high enough probability or a rule hit of severity 2 or more."""
    return F.coalesce(F.col("ml_prob") >= params.theta_medium, F.lit(False)) | (F.col("max_severity") >= 2)


def with_window(
    messages: DataFrame, keys: list[str], order: list[str], params: WindowParams = WindowParams(),
    catalog: Catalog = DEFAULT, piece_rows: int = PIECE_ROWS, counts: bool = False,
) -> DataFrame:
    """Add the window figures of every message: the last `size` messages of its key, itself included.

    `counts` adds category_counts, the categories of the window with the messages that hold them.

    `messages` holds sender, ml_prob, max_severity and cat_mask (all its words). `order` is unique within a key.
    Keys beyond `piece_rows` rows are windowed piece by piece.
    """
    ordinary, hot = split_hot(messages, keys, piece_rows)
    parts = []
    if ordinary is not None:
        parts.append(_window_figures(ordinary, keys, order, params, catalog, counts))
    if hot is not None:
        placed = spread_position(hot, keys, order, "_pos")
        pieces = with_pieces(placed, "_pos", params.size - 1, piece_rows)
        figures = _window_figures(pieces, [*keys, "_piece"], ["_pos"], params, catalog, counts)
        parts.append(figures.filter(~F.col("_halo")).drop("_halo", "_piece", "_pos"))
    return reduce(DataFrame.unionByName, parts)


def _window_figures(
    messages: DataFrame, keys: list[str], order: list[str], params: WindowParams, catalog: Catalog,
    counts: bool = False,
) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(*order)
    frame = by.rowsBetween(-(params.size - 1), 0)
    sofar = by.rowsBetween(Window.unboundedPreceding, 0)
    packed = PackedCounts(catalog, params.size)
    in_frame = lambda sql: F.expr(sql).over(frame)
    before = lambda sql: F.expr(sql).over(by)

    staged = messages.withColumn("_ext", F.col("sender") == EXTERNAL).withColumns({
        "_sev": F.expr("IF(_ext, max_severity, 0)"),
        **{own: F.expr(f"IF(_ext, {column}, 0L)") for own, column in zip(
            scoring.word_names("_mask", catalog), scoring.word_names("cat_mask", catalog))},
        "_high": F.expr(f"int(_ext AND coalesce(ml_prob >= {params.theta_high}D, false))"),
        "_risky": F.col("_ext") & is_risky(params),
    }).withColumns({f"_add{w}": F.expr(packed.contribution("_mask", w)) for w in range(packed.words)})
    staged = staged.withColumns({
        "_ordinal": F.expr("sum(int(_ext))").over(sofar),
        "_ext1": before("lag(_ext, 1, false)"), "_ext2": before("lag(_ext, 2, false)"), "_ext3": before("lag(_ext, 3, false)"),
    }).withColumn("_run", F.expr("_ext AND _ext1 AND _ext2"))  # the last three messages are external

    trust = scoring.has_any("_mask", catalog.mask(catalog.trust))
    solicit = scoring.has_any("_mask", catalog.mask(catalog.solicit))
    # Frames no longer than a run hold one run at most, and none that begins inside them.
    longer = params.size - config.RUN_LENGTH
    inner = by.rowsBetween(-max(longer - 1, 0), 0)
    cut = f"lag(_run, {longer}, false)" if longer >= 0 else "lag(false, 1, false)"
    staged = staged.withColumns({
        "window_len": in_frame("count(1)"),
        "n_external": in_frame("sum(int(_ext))"),
        "high_risk_count": in_frame("sum(_high)"),
        "risky_count": in_frame("sum(int(_risky))"),
        **{whole: in_frame(f"bit_or({own})") for whole, own in zip(
            scoring.word_names("window_mask", catalog), scoring.word_names("_mask", catalog))},
        "_trust": in_frame(f"min(IF({trust}, _ordinal, NULL))"),
        "_solicit": in_frame(f"max(IF({solicit}, _ordinal, NULL))"),
        # Runs that reach their length inside the frame; one cut by the frame start reaches it
        # at the frame's third message.
        "_inner_runs": F.expr(f"sum(int({longer > 0} AND _run AND NOT _ext3))").over(inner),
        "_cut_run": before(cut),
        **{f"_first{k}": in_frame(f"min(IF(_sev >= {k}, _ordinal, NULL))") for k in scoring.SEVERITIES},
        **{f"_last{k}": in_frame(f"max(IF(_sev >= {k}, _ordinal, NULL))") for k in scoring.SEVERITIES},
        **{f"_packed{w}": in_frame(f"sum(_add{w})") for w in range(packed.words)},
    }).withColumn("_gone", F.expr("_ordinal - n_external"))  # external messages that left the frame

    scored = staged.withColumns({
        **{c: F.col(c).cast("int") for c in ("window_len", "n_external", "high_risk_count", "risky_count")},
        "n_runs": F.expr("int(_inner_runs + int(_cut_run))"),
        "base": F.expr(scoring.base_score(packed.count_of, "window_mask", catalog)),
        "cooccur": F.expr(scoring.pair_score("window_mask", catalog)),
        "escal": F.expr(scoring.escalation("n_external", lambda k: f"(_first{k} - _gone)", lambda k: f"(_last{k} - _gone)")),
        "arc": F.expr(scoring.stage_arc("n_external", "(_trust - _gone)", "(_solicit - _gone)", "window_mask", catalog)),
    })
    if counts:
        scored = scored.withColumn("category_counts", F.expr(packed.present()))
    helpers = [c for c in scored.columns if c.startswith("_") and c not in messages.columns]
    return with_score(scored.drop(*helpers))


def with_score(figures: DataFrame) -> DataFrame:
    """Add consec and score; without an external message the window scores 0."""
    return figures.withColumn("consec", F.col("n_runs") * F.lit(config.RUN_BONUS)).withColumn(
        "score", F.col("base") + F.col("cooccur") + F.col("escal") + F.col("arc") + F.col("consec")
    )


def window_stats(scored: DataFrame, keys: list[str], catalog: Catalog = DEFAULT) -> DataFrame:
    """One row of window statistics per message, whoever sent it."""
    return scored.select(
        *keys, "window_len", "high_risk_count", "risky_count", F.round("score", 2).alias("score"),
        mask_categories("window_mask", catalog).alias("cats"),
        (F.col("escal") > 0).alias("escal"), (F.col("arc") > 0).alias("arc"),
    )


def _cats(mask: str, catalog: Catalog, empty: str) -> Column:
    names = F.array_join(mask_categories(mask, catalog), ", ")
    return F.concat(F.lit("cats=["), F.when(names == "", F.lit(empty)).otherwise(names), F.lit("]"))


def alerts(scored: DataFrame, params: WindowParams = WindowParams(), catalog: Catalog = DEFAULT) -> DataFrame:
    """Alert rows: external messages for which one of the ordered conditions holds."""
    cats = _cats("window_mask", catalog, "none")
    score = F.format_string("%.1f", F.col("score"))
    extras = F.concat_ws(
        ", ", F.when(F.col("escal") > 0, F.lit("ESCALATION")), F.when(F.col("arc") > 0, F.lit("STAGE ARC"))
    )
    cascade = [
        (F.col("max_severity") == 3, "Critical",
         F.concat(F.lit("Explicit grooming indicator | "), _cats("cat_mask", catalog, ""))),
        (F.col("high_risk_count") >= params.high_count, "High",
         F.concat(F.lit("High-confidence ML ("), F.col("high_risk_count"), F.lit(f" msgs >= {params.theta_high}) | score="),
                  score, F.lit(" | "), cats)),
        (F.col("score") >= params.score_high, "High",
         F.concat(F.lit("Window risk="), score, F.lit(f" >= {params.score_high} | "), cats,
                  F.when(extras == "", F.lit("")).otherwise(F.concat(F.lit(" | "), extras)))),
        (F.col("risky_count") >= params.risky_count, "Medium",
         F.concat(F.lit("Sustained pattern ("), F.col("risky_count"), F.lit(" msgs, score="), score, F.lit(") | "), cats)),
        (F.col("score") >= params.score_medium, "Medium",
         F.concat(F.lit("Window risk="), score, F.lit(f" >= {params.score_medium} | "), cats)),
    ]
    branch = F.coalesce(*[F.when(cond, F.lit(i)) for i, (cond, _, _) in enumerate(cascade)])
    by_branch = lambda values: F.coalesce(*[F.when(F.col("_branch") == i, v) for i, v in enumerate(values)])
    return (
        scored.withColumn("_branch", F.when(F.col("sender") == EXTERNAL, branch))
        .filter(F.col("_branch").isNotNull())
        .withColumn("level", by_branch([F.lit(level) for _, level, _ in cascade]))
        .withColumn("reason", by_branch([reason for _, _, reason in cascade]))
        .withColumn("signals", F.create_map(
            F.lit("ESC"), F.when(F.col("escal") > 0, F.lit("yes")).otherwise(F.lit("")),
            F.lit("ARC"), F.when(F.col("arc") > 0, F.lit("yes")).otherwise(F.lit("")),
        ))
        .drop("_branch")
    )


def render_alert(text: str = "text", matches: str = "matches") -> Column:
    """Alert as several lines of text."""
    signals = F.concat_ws(
        "  ", *[F.when(F.col("signals")[k] != "", F.concat(F.lit(f"{k}="), F.col("signals")[k])) for k in ("ESC", "ARC")]
    )
    rules = F.transform(matches, lambda m: F.concat(
        F.lit("  rule     : ["), m["category"], F.lit(" sev="), m["severity"].cast("string"),
        F.lit("] '"), m["text"], F.lit("'")))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("["), F.upper("level"), F.lit("] "), F.col("reason")),
        F.concat(F.lit("  message  : '"), F.substring(text, 1, 120), F.lit("'")),
        F.concat(F.lit("  ml_prob  : "), F.format_string("%.3f", F.col("ml_prob"))),
        F.concat(F.lit("  score    : "), F.format_string("%.2f", F.col("score"))),
        F.when(signals != "", F.concat(F.lit("  signals  : "), signals)),
        rules,
    )
