"""Joins against small tables, with the size checked before broadcasting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000
#: A key with more rows than this is joined apart from the others.
HOT_ROWS = 1 << 17


def fits_broadcast(small: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether the table has at most so many rows; a count sends one number per task."""
    return small.count() <= limit


def same_keys(big: DataFrame, small: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join on columns of one name where NULL equals NULL; the keys of `big` are kept."""
    renamed = small.withColumnsRenamed({k: f"_same_{k}" for k in on})
    condition: Column = reduce(lambda a, b: a & b, [big[k].eqNullSafe(renamed[f"_same_{k}"]) for k in on])
    return big.join(renamed, condition, how).drop(*[f"_same_{k}" for k in on])


def lookup_join(
    big: DataFrame, small: DataFrame, on: list[str], how: str = "left",
    limit: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS, *, null_safe: bool = False,
) -> DataFrame:
    """Join `big` with a table that is unique on `on`.

    Up to `limit` rows the table is broadcast. Beyond it both sides shuffle on the key, but for the keys with more than
    `hot_rows` rows in `big`: there are few of those, so their part of the table is broadcast to them. Keys are counted
    before that, combined per task.
    """
    def join(rows: DataFrame, table: DataFrame) -> DataFrame:
        return same_keys(rows, table, on, how) if null_safe else rows.join(table, on, how)

    if fits_broadcast(small, limit):
        return join(big, F.broadcast(small))
    hot = big.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows).drop("_n")
    keys = hot.collect()  # at most one per `hot_rows` rows of the big side
    if not keys:
        return join(big, small)
    hot = F.broadcast(big.sparkSession.createDataFrame(keys, hot.schema))
    parted = same_keys(big, hot.withColumn("_hot", F.lit(True)), on, "left")
    ordinary, many = parted.filter(F.col("_hot").isNull()).drop("_hot"), parted.filter("_hot").drop("_hot")
    return join(ordinary, small).unionByName(join(many, F.broadcast(same_keys(small, hot, on, "left_semi"))))


def semi_join(df: DataFrame, keys_df: DataFrame, on: list[str], keep: bool, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows whose key is (or is not) in `keys_df`, which is unique on `on`; NULL is a key like any other."""
    return lookup_join(df, keys_df, on, "left_semi" if keep else "left_anti", limit, null_safe=True)
