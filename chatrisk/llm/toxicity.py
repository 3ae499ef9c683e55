"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insult, threat, target, negation, report or other. Insult arcs come from a short list and
from labelled documents: words and word beginnings that occur significantly more often in toxic ones, weighted by
their log odds. Transducers read the symbols of a clause: one follows the scope of a negation, one reported
speech, one whether a target has been named, one threats. Their product is built once; a clause's score is the
sum of the weights its insults and threats get in it. A document's score is a logistic function of its clauses'
scores, fitted to counts of labelled documents by cells of those scores.

Labels are used for learning only. Null and empty texts have no clause and get the score of no match. Rows are
independent; repeated labels of an id count as toxic if one is. Without labels, the listed words alone decide.
Extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from chatrisk.llm.batches import PLAIN, byte_texts, checked_join, map_batches
from chatrisk.plans.checkpoints import checkpointed
from chatrisk.plans.joins import fits_broadcast, lookup_join

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
SEED_WEIGHT = 3.0
SYMBOLS = {
    INSULT: "idiot idiots moron morons loser losers scum trash worthless pathetic disgusting clown stupid imbecile dumb "
            "idiota imbécil estúpido estúpida basura asqueroso abruti débile ordure minable crétin dummkopf "
            "abschaum versager trottel erbärmlich widerlich",
    THREAT: "kill hurt destroy beat burn crush punish matar destruir golpear tuer frapper détruire töten schlagen vernichten",
    TARGET: "you your yours u they them he she him her tu vous toi vos tú usted ustedes du dich dir ihr euch sie",
    NEGATION: "not never no isnt arent dont wasnt without nicht kein keine nie ohne pas jamais sans nunca sin",
    REPORT: "said says say claims claimed wrote quoted quote according reported sagte schrieb laut dit écrit selon dijo escribió según",
}
#: Bytes of word beginnings that are counted beside whole words.
STEMS = (4, 5, 6)
#: Least likelihood ratio of a learned arc, least number of toxic documents with it, and largest weight.
LEAST_RATIO, LEAST_DOCUMENTS, MOST_WEIGHT = 24.0, 5, 5.0
#: Arcs that every task gets; more are joined to the words of each text.
SHARED_ARCS = 50_000
HELD_FEATURES = 1 << 20
#: Cells of a score: its square root in steps of this size, up to BINS.
BIN, BINS = 0.25, 40

_CLAUSES = bytes(10 if chr(c) in ".!?;:\n" else PLAIN[c] for c in range(256))


@dataclass(frozen=True)
class Transducer:
    """Arcs (state, symbol) -> (state, factor on the weight of the symbol read); missing arcs stay, factor 1."""

    states: int
    arcs: dict[tuple[int, int], tuple[int, float]]

    def step(self, state: int, symbol: int) -> tuple[int, float]:
        return self.arcs.get((state, symbol), (state, 1.0))


#: A negation halves the insults and threats of the next three symbols and more.
NEGATED = Transducer(4, {
    **{(s, NEGATION): (3, 1.0) for s in range(4)},
    **{(s, x): (s - 1, 0.5) for s in (1, 2, 3) for x in (INSULT, THREAT)},
    **{(s, x): (s - 1, 1.0) for s in (1, 2, 3) for x in (OTHER, TARGET)},
})
#: After a word of reporting, the rest of the clause is somebody else's.
REPORTED = Transducer(2, {(0, REPORT): (1, 1.0), (1, INSULT): (1, 0.6), (1, THREAT): (1, 0.4)})
#: A named target makes what follows stronger.
TARGETED = Transducer(2, {(0, TARGET): (1, 1.0), (1, INSULT): (1, 1.3), (1, THREAT): (1, 1.3)})
#: A threat counts if the clause has a target or an insult by then.
THREATENED = Transducer(2, {(0, TARGET): (1, 1.0), (0, INSULT): (1, 1.0), (0, THREAT): (0, 0.0)})
GRAMMAR = (NEGATED, REPORTED, TARGETED, THREATENED)


def composed(parts: tuple[Transducer, ...] = GRAMMAR) -> dict[tuple[int, int], tuple[int, float]]:
    """The product of the transducers: states are numbered tuples, factors are multiplied."""
    states = {s: i for i, s in enumerate(product(*(range(p.states) for p in parts)))}
    out = {}
    for state, number in states.items():
        for symbol in range(6):
            steps = [p.step(s, symbol) for p, s in zip(parts, state)]
            out[number, symbol] = (states[tuple(s for s, _ in steps)], math.prod(f for _, f in steps))
    return out


class Lexicon(dict):
    """(symbol, weight) of words, remembered up to a bound; None for words without meaning here."""

    def __init__(self, arcs: dict[bytes, float]):
        super().__init__()
        self.arcs = arcs
        self.fixed = {w.encode(): symbol for symbol, words in SYMBOLS.items() for w in words.split()}

    def __missing__(self, word: bytes):
        if len(self) > 1 << 18:
            self.clear()
        learned = max((self.arcs.get(f, 0.0) for f in features_of(word)), default=0.0)
        symbol = self.fixed.get(word)
        if learned > 0 and symbol in (None, INSULT):
            entry = (INSULT, max(learned, SEED_WEIGHT if symbol == INSULT else 0.0))
        elif symbol is None:
            entry = None
        else:
            entry = (symbol, SEED_WEIGHT if symbol in (INSULT, THREAT) else 0.0)
        self[word] = entry
        return entry


def features_of(word: bytes) -> list[bytes]:
    """A word and its beginnings, the latter marked by a star."""
    return [word, *(word[:n] + b"*" for n in STEMS if len(word) > n)]


class Clauses:
    """Scores the clauses of texts with a lexicon and the composed grammar."""

    def __init__(self, arcs: dict[bytes, float]):
        self.lexicon, self.table = Lexicon(arcs), composed()

    def scores(self, text: bytes) -> list[float]:
        """The scores of the matched clauses."""
        entry, found = self.lexicon.__getitem__, []
        for clause in text.translate(_CLAUSES).split(b"\n"):
            symbols = list(map(entry, clause.split()))
            if any(s is not None and s[1] for s in symbols):
                found.append(self._clause(symbols))
        return found

    def _clause(self, symbols: list) -> float:
        state, total = 0, 0.0
        for s in symbols:
            symbol, weight = s or (OTHER, 0.0)
            state, factor = self.table[state, symbol]
            total += factor * weight
        return total


def learned_arcs(docs: DataFrame) -> DataFrame | None:
    """(feature, weight) of words and beginnings that mark toxic documents, or None without both labels; docs (text, toxic)."""
    schema = StructType([StructField("feature", BinaryType()), StructField("toxic", LongType()), StructField("clean", LongType())])

    def given(counts: list[Counter]) -> pa.RecordBatch:
        names = list(counts[0].keys() | counts[1].keys())
        columns = [pa.array(names, pa.binary()), *(pa.array([c[n] for n in names], pa.int64()) for c in (counts[1], counts[0]))]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter(), Counter()]
        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), byte_texts(batch.column("text"))):
                own = {f for w in set(text.translate(PLAIN).split()) for f in features_of(w)}
                counts[toxic].update(own | {b""})
            if len(counts[0]) + len(counts[1]) > HELD_FEATURES:
                yield given(counts)
        yield given(counts)

    found = checkpointed(
        docs.mapInArrow(count, schema).groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
        .filter((F.col("a") >= LEAST_DOCUMENTS) | (F.octet_length("feature") == 0)),
        "arcs",
    )
    sizes = found.filter(F.octet_length("feature") == 0).select("a", "b").first()
    if sizes is None or not sizes[0] or not sizes[1]:
        return None
    toxic, clean = sizes
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    share = (a + b) / F.lit(float(toxic + clean))
    part = lambda x, n: F.when(x > 0, x * F.log(x / (share * n))).otherwise(0.0)
    # The likelihood ratio of the table of documents with and without the feature, by label.
    ratio = 2 * (part(a, float(toxic)) + part(b, float(clean)))
    odds = F.log((a + 0.5) / (toxic + 1.0)) - F.log((b + 0.5) / (clean + 1.0))
    return (
        found.filter(F.octet_length("feature") > 0).select("feature", ratio.alias("ratio"), odds.alias("odds"))
        .filter((F.col("ratio") >= LEAST_RATIO) & (F.col("odds") >= 2.0))
        .select("feature", F.least("odds", F.lit(MOST_WEIGHT)).alias("weight"))
    )


def clause_sums(docs: DataFrame, arcs: DataFrame | None, keep: list[str], shared: int = SHARED_ARCS) -> DataFrame:
    """`keep` columns with top and total: the best clause's score and the sum over clauses.

    Up to `shared` arcs (feature, weight) go to all tasks; more of them meet the words of each text in a join.
    """
    fields = [StructField("top", DoubleType()), StructField("total", DoubleType())]
    if arcs is not None and not fits_broadcast(arcs, shared):
        return _joined_sums(docs, arcs, fields, keep)
    weights = {bytes(r["feature"]): r["weight"] for r in arcs.collect()} if arcs is not None else {}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        grammar = Clauses(weights)
        for batch in batches:
            found = [grammar.scores(t) for t in byte_texts(batch.column("text"))]
            yield batch, [pa.array([max(s, default=0.0) for s in found]), pa.array([float(sum(s)) for s in found])]

    return map_batches(docs, score, fields, keep)


def _joined_sums(docs: DataFrame, arcs: DataFrame, fields: list[StructField], keep: list[str]) -> DataFrame:
    rows = checkpointed(docs.select(*keep, "text").withColumn("_row", F.monotonically_increasing_id()), "clause-rows")
    schema = StructType([StructField("_row", LongType()), StructField("feature", BinaryType())])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("_row").to_pylist(), byte_texts(batch.column("text"))):
                own = list({f for w in set(text.translate(PLAIN).split()) for f in features_of(w)})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), row, np.int64)), pa.array(own, pa.binary())], names=schema.names)

    met = lookup_join(rows.select("_row", "text").mapInArrow(features, schema), arcs, ["feature"], "inner")
    own_arcs = met.groupBy("_row").agg(F.collect_list(F.struct("feature", "weight")).alias("_arcs"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        grammar = Clauses({})
        for batch in batches:
            found = []
            for text, own in zip(byte_texts(batch.column("text")), batch.column("_arcs").to_pylist()):
                grammar.lexicon = Lexicon({bytes(a["feature"]): a["weight"] for a in own or []})
                found.append(grammar.scores(text))
            yield batch, [pa.array([max(s, default=0.0) for s in found]), pa.array([float(sum(s)) for s in found])]

    return map_batches(rows.join(own_arcs, "_row", "left"), score, fields, keep)


def _bin(score: str) -> Column:
    return F.least(F.round(F.sqrt(score) / BIN), F.lit(float(BINS)))


def calibrated(sums: DataFrame) -> list[float]:
    """Weights of a logistic function of (1, any match, top bin, total bin), by Newton's method on cells of (top, total, toxic)."""
    cells = sums.groupBy(_bin("top").alias("x"), _bin("total").alias("y")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("ones")
    ).orderBy("x", "y").collect()
    if not cells or not 0 < sum(r["ones"] for r in cells) < sum(r["n"] for r in cells):
        return [-3.0, 0.0, 6.0, 2.0]
    inputs = np.array([[1.0, r["x"] > 0, r["x"] / 10, r["y"] / 10] for r in cells])
    n, ones = np.array([r["n"] for r in cells], float), np.array([r["ones"] for r in cells], float)
    weights = np.zeros(4)
    prior = np.diag([0.01, 0.1, 0.1, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-inputs @ weights))
        step = np.linalg.solve(inputs.T @ (inputs * (n * p * (1 - p))[:, None]) + prior, inputs.T @ (ones - n * p) - prior @ weights)
        weights += np.clip(step, -2, 2)
    return weights.tolist()


def scored(docs: DataFrame, labels: DataFrame, is_held: Callable[[Column], Column]) -> DataFrame:
    """doc_id, held_out, top, total, score and predicted of every text; `is_held` marks ids not learned from.

    Labels are 0 and 1; others, null ones too, teach nothing. Of several labels of an id 1 counts before 0.
    """
    own = labels.filter(F.col("toxic").isin(0, 1) & ~is_held(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic")
    )
    known = checked_join(docs.select("doc_id", "text"), checkpointed(own, "labels"), ["doc_id"], "inner")
    arcs = learned_arcs(known.select("text", "toxic"))
    sums = checkpointed(clause_sums(docs.select("doc_id", "text"), arcs, ["doc_id"]), "clauses")
    weights = calibrated(checked_join(sums, own, ["doc_id"], "inner"))
    x, y = _bin("top"), _bin("total")
    z = F.lit(weights[0]) + weights[1] * (x > 0).cast("double") + weights[2] * x / 10 + weights[3] * y / 10
    score = 1 / (1 + F.exp(-z))
    return sums.withColumn("score", score).select(
        "doc_id", F.coalesce(is_held(F.col("doc_id")), F.lit(False)).alias("held_out"), "top", "total", "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
