"""Parallelism for small inputs of costly rows."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread_small(df: DataFrame) -> DataFrame:
    """Deal rows over all cores when the input has fewer partitions than cores.

    A table of ordinary size has many more partitions and passes through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
