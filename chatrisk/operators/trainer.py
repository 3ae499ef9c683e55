"""A weighted linear classifier trained in epochs, with early stop on validation F2.

Texts become hashed word ids once, in a table; every epoch is one pass over it. A task adds up the gradient of its rows,
the gradients of tasks are summed in a tree, and the driver holds the weights, whose number is a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatrisk.operators.evaluation import calibrate, with_class_weight
from chatrisk.plans.checkpoints import checkpointed

FEATURES = 1 << 16
FAN = 16  # gradients summed by one task of the tree
LOG_SCHEMA = "run INT, epoch INT, loss DOUBLE, threshold DOUBLE, f2 DOUBLE"


@dataclass(frozen=True)
class LinearModel:
    weights: np.ndarray  # per word id, and the constant at the end
    importance: np.ndarray  # inverse document frequency per word id
    threshold: float

    def score(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Add prob, the probability of label 1."""
        found = _scored(with_ids(df, text, len(self.importance)), self.weights, self.importance)
        return found.drop("_ids")


def with_ids(df: DataFrame, text: str, features: int) -> DataFrame:
    """Add the hashed ids of all words, repeats included."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    return df.withColumn("_ids", F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(features)).cast("int")))


def _margins(batch: pa.RecordBatch, weights: np.ndarray, importance: np.ndarray) -> tuple[np.ndarray, ...]:
    """(margin of every row, row of every word, id of every word, its value): a row's values add up to its mean."""
    lists = batch.column("_ids")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    value = importance[ids] / np.maximum(sizes, 1)[row]
    return np.bincount(row, weights[ids] * value, minlength=len(sizes)) + weights[-1], row, ids, value


def _probability(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def _scored(rows: DataFrame, weights: np.ndarray, importance: np.ndarray) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast((weights, importance))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = _margins(batch, *sent.value)[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_probability(margin))], names=[*batch.schema.names, "prob"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
    return rows.mapInArrow(run, ", ".join([*kept, "prob DOUBLE"]))


def word_importance(rows: DataFrame, features: int) -> np.ndarray:
    """log((n + 1) / (documents with the word + 1)) per id; at most `features` counts come to the driver."""
    counts = rows.select(F.explode(F.array_distinct("_ids")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    found = np.zeros(features)
    for row in counts.collect():
        found[row.id] = row.n
    return np.log((rows.count() + 1) / (found + 1))


def gradient(rows: DataFrame, weights: np.ndarray, importance: np.ndarray) -> tuple[np.ndarray, float]:
    """Mean gradient of the weighted logistic loss, and the mean loss."""
    sent = rows.sparkSession.sparkContext.broadcast((weights, importance))
    schema = "slot INT, total BINARY"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, scale = sent.value
        total = np.zeros(len(own) + 2)  # gradient, loss, weight
        for batch in batches:
            margin, row, ids, value = _margins(batch, own, scale)
            label, weight = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "weight"))
            error = weight * (_probability(margin) - label)
            total[: len(scale)] += np.bincount(ids, error[row] * value, minlength=len(scale))
            total[len(scale)] += error.sum()
            total[-2] += (weight * np.logaddexp(0, np.where(label > 0, -margin, margin))).sum()
            total[-1] += weight.sum()
        yield pa.RecordBatch.from_pydict({"slot": pa.array([TaskContext.get().partitionId()], pa.int32()), "total": [total.tobytes()]})

    def summed(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(t) for t in table.column("total").to_pylist())
        return pa.table({"slot": table.column("slot").slice(0, 1), "total": [total.tobytes()]})

    parts, n = rows.mapInArrow(partial, schema), rows.rdd.getNumPartitions()
    while n > FAN:
        parts = parts.withColumn("slot", F.floor(F.col("slot") / FAN).cast("int")).groupBy("slot").applyInArrow(summed, schema)
        n = -(-n // FAN)
    total = sum(np.frombuffer(r.total) for r in parts.collect())
    return total[:-2] / total[-1], total[-2] / total[-1]


def train_epochs(
    train: DataFrame, validation: DataFrame, *, text: str = "text", scale: float = 3.0, epochs: int = 20, patience: int = 3,
    rate: float = 0.1, strength: float = 1e-4, features: int = FEATURES,
) -> tuple[LinearModel, DataFrame]:
    """(model of the best epoch, epoch log). `train` and `validation` hold the text and label 0 or 1.

    Positives weigh `scale` times their rarity. An epoch is best when its validation F2, at the threshold that is best
    for it, beats 0 and all before; after `patience` epochs without a new best the run stops. Without any best epoch the
    last weights and the default threshold are kept. The log has run, epoch, loss, threshold and f2 as `epoch_choice` reads them.
    """
    own = with_ids(with_class_weight(train, scale), text, features)
    rows = checkpointed(own.select("_ids", F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight")), "training")
    held = checkpointed(with_ids(validation, text, features).select("_ids", F.col("label").cast("int").alias("label")), "validation")
    importance = word_importance(rows, features)
    weights, first, second = np.zeros(features + 1), np.zeros(features + 1), np.zeros(features + 1)
    best, best_f2, waited, log = LinearModel(weights, importance, 0.5), 0.0, 0, []
    for epoch in range(epochs):
        step, loss = gradient(rows, weights, importance)
        step = step + strength * np.append(weights[:-1], 0.0)
        first, second = 0.9 * first + 0.1 * step, 0.999 * second + 0.001 * step**2
        moved = rate * (first / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(second / (1 - 0.999 ** (epoch + 1))) + 1e-8)
        weights = weights - moved
        chosen = calibrate(_scored(held, weights, importance).select("prob", "label")).first()
        log.append((0, epoch, float(loss), float(chosen["threshold"]), float(chosen["f2"])))
        waited += 1
        if chosen["f2"] > best_f2:
            best, best_f2, waited = LinearModel(weights, importance, float(chosen["threshold"])), chosen["f2"], 0
        elif best_f2 == 0:
            best = LinearModel(weights, importance, 0.5)
        if waited >= patience:
            break
    return best, train.sparkSession.createDataFrame(log, LOG_SCHEMA)
