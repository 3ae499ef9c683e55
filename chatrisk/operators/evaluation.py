"""Classification metrics, threshold calibration, class weights, epoch choice."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatrisk import config
from chatrisk.plans.joins import lookup_join
from chatrisk.plans.skew import PIECE_ROWS, hot_keys, with_position

# The thresholds tried, 0.05 to 0.94 in steps of 0.01, as that range yields them.
GRID = [float(t) for t in np.arange(0.05, 0.95, 0.01)]
DEFAULT_THRESHOLD = 0.5


def f_beta(precision: Column, recall: Column, beta: float = config.BETA) -> Column:
    weight = beta * beta
    below = F.lit(weight) * precision + recall
    return F.when(below == 0, F.lit(0.0)).otherwise(F.lit(1 + weight) * precision * recall / F.nullif(below, F.lit(0.0)))


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def align_scores(labels: DataFrame, scores: DataFrame, on: str) -> DataFrame:
    """Labels with their predictions, by id; a label without one stays, and counts as not hit."""
    return labels.join(scores, on, "left")


def confusion(scored: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    hit, true = F.coalesce(F.col("prob") >= threshold, F.lit(False)), F.col("label") == 1
    count = lambda condition: F.coalesce(F.sum(condition.cast("bigint")), F.lit(0))
    return scored.agg(count(hit & true).alias("tp"), count(hit & ~true).alias("fp"), count(~hit & true).alias("fn"))


def with_metrics(counts: DataFrame, beta: float = config.BETA) -> DataFrame:
    """Add precision, recall and f2 to tp, fp, fn."""
    ratio = lambda other: F.when(F.col("tp") + F.col(other) > 0, F.col("tp") / F.nullif(F.col("tp") + F.col(other), F.lit(0))).otherwise(0.0)
    return counts.withColumns({"precision": ratio("fp"), "recall": ratio("fn")}).withColumn(
        "f2", f_beta(F.col("precision"), F.col("recall"), beta))


def metrics(scored: DataFrame, threshold: float = DEFAULT_THRESHOLD, beta: float = config.BETA) -> DataFrame:
    """precision, recall, f2, tp, fp, fn and the threshold, one row."""
    return with_metrics(confusion(scored, threshold), beta).withColumn("threshold", F.lit(threshold))


def threshold_table(scored: DataFrame, beta: float = config.BETA) -> DataFrame:
    """Metrics at every threshold of the grid from one pass over the scores.

    A score counts for all thresholds up to it, so a histogram over the grid, summed from the top,
    holds every confusion table.
    """
    splits = [-float("inf"), *GRID, float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol="prob", outputCol="_reached").transform(
        scored.select(F.col("prob").cast("double"), "label"))
    reached = bucketed.groupBy(F.col("_reached").cast("int").alias("step")).agg(
        F.sum((F.col("label") == 1).cast("bigint")).alias("pos"), F.sum((F.col("label") != 1).cast("bigint")).alias("neg"))
    spark = scored.sparkSession
    grid = spark.createDataFrame([(0, None), *((i + 1, t) for i, t in enumerate(GRID))], "step INT, threshold DOUBLE")
    # At most one row per grid point from here on.
    steps = grid.join(reached, "step", "left").fillna(0, subset=["pos", "neg"])
    upward = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    counted = steps.withColumns({
        "tp": F.sum("pos").over(upward), "fp": F.sum("neg").over(upward),
        "fn": F.sum("pos").over(whole) - F.sum("pos").over(upward),
    })
    return with_metrics(counted.filter("step > 0"), beta).select("threshold", "tp", "fp", "fn", "precision", "recall", "f2")


def calibrate(scored: DataFrame, beta: float = config.BETA) -> DataFrame:
    """The lowest threshold with the highest F-score; 0.5 when every F-score is 0."""
    best = threshold_table(scored, beta).agg(F.max_by("threshold", F.struct("f2", -F.col("threshold"))).alias("t"), F.max("f2").alias("f2"))
    return best.select(F.when(F.col("f2") > 0, F.col("t")).otherwise(DEFAULT_THRESHOLD).alias("threshold"), "f2")


def evaluate(labels: DataFrame, scores: DataFrame, on: str, threshold: float) -> DataFrame:
    """Metrics of a scored table at a saved threshold."""
    return metrics(align_scores(labels, scores, on), threshold)


def class_weights(labelled: DataFrame, scale: float = 3.0) -> DataFrame:
    """(label, weight): 1 for negatives, scale * negatives / positives for positives.

    Without positives the weight is undefined, and computing it is an error.
    """
    counts = labelled.agg(
        F.coalesce(F.sum((F.col("label") == 1).cast("bigint")), F.lit(0)).alias("n_pos"), F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("n_neg", F.col("n") - F.col("n_pos"))
    positive = F.when(F.col("n_pos") > 0, F.lit(scale) * (F.col("n_neg") / F.nullif(F.col("n_pos"), F.lit(0)))).otherwise(
        F.raise_error(F.lit("no positive rows to weight")).cast("double"))
    return counts.select(F.inline(F.array(
        F.struct(F.lit(0).alias("label"), F.lit(1.0).alias("weight"), "n_pos", "n_neg"),
        F.struct(F.lit(1).alias("label"), positive.alias("weight"), "n_pos", "n_neg"))))


def with_class_weight(labelled: DataFrame, scale: float = 3.0) -> DataFrame:
    """Add the row's class weight."""
    weights = class_weights(labelled, scale).select("label", "weight")
    return labelled.join(F.broadcast(weights), "label")  # two rows


def epoch_choice(log: DataFrame, keys: list[str], patience: int, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Add is_best, no_improve (epochs since the last best) and ran (the run still goes) per epoch.

    `log` holds epoch and f2. An epoch is best when it beats 0 and all before it. A run stops at the
    first epoch that ends `patience` epochs in a row without a new best. Each of the three is a
    running maximum, so a long run is worked on in pieces that carry the maximum of earlier ones.
    """
    placed = with_position(log, keys, ["epoch"], "_pos", piece_rows).withColumn("_piece", F.floor(F.col("_pos") / piece_rows))
    many = hot_keys(log, keys, piece_rows) is not None

    def max_before(df: DataFrame, value: str, out: str) -> DataFrame:
        earlier_rows = Window.partitionBy(*keys, "_piece").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
        inside = F.coalesce(F.max(value).over(earlier_rows), F.lit(0))
        if not many:
            return df.withColumn(out, inside)
        tops = df.groupBy(*keys, "_piece").agg(F.max(value).alias("_top"))
        earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
        carried = tops.select(*keys, "_piece", F.coalesce(F.max("_top").over(earlier), F.lit(0)).alias("_carried"))
        return lookup_join(df, carried, [*keys, "_piece"]).withColumn(out, F.greatest(inside, "_carried")).drop("_carried")

    marked = max_before(placed, "f2", "_best").withColumn("is_best", F.col("f2") > F.col("_best"))
    marked = marked.withColumn("_place", F.when(F.col("is_best"), F.col("_pos") + 1))
    counted = max_before(marked, "_place", "_last").withColumn(
        "no_improve", F.col("_pos") + 1 - F.coalesce("_place", "_last"))
    counted = counted.withColumn("_stop", (F.col("no_improve") >= patience).cast("int"))
    chosen = max_before(counted, "_stop", "_stopped").withColumn("ran", F.col("_stopped") == 0)
    return chosen.drop("_pos", "_piece", "_best", "_place", "_last", "_stop", "_stopped")


def best_epoch(log: DataFrame, keys: list[str], patience: int, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Per run: last epoch run, best epoch, its f2; epoch NULL and f2 0 when nothing beat 0."""
    chosen = epoch_choice(log, keys, patience, piece_rows).filter("ran")
    best = F.when(F.col("is_best"), F.col("epoch"))
    return chosen.groupBy(*keys).agg(
        F.max("epoch").alias("last_epoch"), F.max(best).alias("best_epoch"),
        F.coalesce(F.max(F.when(F.col("is_best"), F.col("f2"))), F.lit(0.0)).alias("best_f2"))
