"""A weighted linear text classifier, batch scoring, and fixed-length token sequences."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatrisk import config
from chatrisk.operators.evaluation import calibrate, metrics, with_class_weight
from chatrisk.plans.checkpoints import checkpointed
from chatrisk.plans.workers import once_per_worker

HASH_SPACE = 1 << 20
#: Bytes of a batch of texts sent to Python; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20


def fit_classifier(
    train: DataFrame, validation: DataFrame, *, text: str = "text", scale: float = 3.0,
    strengths=(0.01, 0.1), features: int = 1 << 16, max_iter: int = 20,
) -> tuple[PipelineModel, float, float]:
    """Logistic regression on hashed words, positives weighted up; the regularisation with the best
    F2 on validation wins. Returns (model, threshold, f2). The model is linear, not a transformer.

    Words and their document frequencies are found once and written; every strength is fitted to that table.
    """
    weighted = with_class_weight(train, scale).withColumn("label", F.col("label").cast("double"))
    best: tuple[PipelineModel | None, float, float] = (None, 0.5, -1.0)
    words = Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\s+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_features"),
    ]).fit(weighted)
    featured = checkpointed(words.transform(weighted).select("_features", "label", "weight"), "features")
    held = checkpointed(words.transform(validation).drop("_words", "_tf"), "held-features")
    for strength in strengths:
        regression = LogisticRegression(
            featuresCol="_features", labelCol="label", weightCol="weight", regParam=strength, maxIter=max_iter)
        fitted = regression.fit(featured)
        found = calibrate(score(PipelineModel(stages=[fitted]), held)).first()
        if found["f2"] > best[2]:
            best = (PipelineModel(stages=[*words.stages, fitted]), found["threshold"], found["f2"])
    return best


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add prob, the probability of label 1."""
    scored = model.transform(df).withColumn("prob", vector_to_array("probability")[1])
    return scored.drop("_words", "_tf", "_features", "rawPrediction", "probability", "prediction")


def score_with(
    load: Callable[[], Callable[[pd.Series], pd.Series]], df: DataFrame, text: str = "text", *,
    model_key: str | None = None, size: int = 256,
) -> DataFrame:
    """Add prob from any model. `load` returns texts -> probabilities, which gets `size` texts at most.

    It runs once per Python worker for a `model_key`, whatever the number of tasks; name the model and its version
    there. Without a key it runs once per task. A batch on its way to Python is bounded in rows and bytes. What a model
    leaves in reference cycles (`Series.str` makes one) is freed after each batch: Python itself waits for a number of
    objects, whatever the size of their texts.
    """
    session = df.sparkSession
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
    session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    @F.arrow_udf("double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = once_per_worker(("model", model_key), load) if model_key else load()
        for batch in batches:
            parts = [pa.Array.from_pandas(model(batch.slice(at, size).to_pandas()).astype("float64")) for at in range(0, len(batch), size)]
            gc.collect(1)
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.float64())

    return df.withColumn("prob", predict(F.col(text)))


def evaluate_classifier(model: PipelineModel, test: DataFrame, threshold: float) -> DataFrame:
    return metrics(score(model, test), threshold, config.BETA)


def token_sequences(df: DataFrame, text: str = "text", length: int = 512, space: int = HASH_SPACE) -> DataFrame:
    """Add input_ids, attention_mask and token_type_ids of a fixed length: hashed words, cut or padded with 0.

    A text is one segment, so every token type is 0.
    """
    words = F.slice(F.filter(F.split(F.col(text), r"\s+"), lambda w: w != ""), 1, length)
    staged = df.withColumn("_words", words).withColumn("n_tokens", F.size("_words"))
    pad = F.array_repeat(F.lit(0).cast("bigint"), F.lit(length) - F.col("n_tokens"))
    ids = F.transform("_words", lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % F.lit(space - 1) + 1)
    mask = F.concat(
        F.array_repeat(F.lit(1), F.col("n_tokens")), F.array_repeat(F.lit(0), F.lit(length) - F.col("n_tokens")))
    return staged.withColumns({"input_ids": F.concat(ids, pad), "attention_mask": mask, "token_type_ids": F.array_repeat(F.lit(0), F.lit(length))}).drop("_words")
