"""Ordered work on keys of any size.

A key with few rows is handled by an ordinary Window. A hot key is cut into pieces of bounded
length by its row positions, and a piece that needs the rows before it gets copies of the last
few rows of the previous piece (its halo). The result is the same either way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatrisk.plans.checkpoints import checkpointed
from chatrisk.plans.joins import lookup_join, semi_join

PIECE_ROWS = 1 << 17


def hot_keys(df: DataFrame, keys: list[str], limit: int = PIECE_ROWS) -> DataFrame | None:
    """Keys with more than `limit` rows, or None when there are none.

    Only the key columns are read, and counts are combined before the shuffle.
    """
    if df.count() <= limit:
        return None
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")) if keys else df.agg(F.count(F.lit(1)).alias("_n"))
    hot = checkpointed(counts.filter(F.col("_n") > limit).select(*keys, "_n"), "hot-keys")
    return None if hot.isEmpty() else hot.select(*keys)


def split_hot(
    df: DataFrame, keys: list[str], limit: int = PIECE_ROWS, *, materialise: bool = True,
) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows of ordinary keys, rows of hot keys); a side that cannot have rows is None.

    Every row is worked on in one of the two. `materialise` writes the hot rows alone, since their order and their
    pieces are found in several passes.
    """
    hot = hot_keys(df, keys, limit)
    if hot is None:
        return df, None
    if not keys:
        return None, df
    many = semi_join(df, hot, keys, keep=True)
    return semi_join(df, hot, keys, keep=False), checkpointed(many, "skewed") if materialise else many


def with_position(
    df: DataFrame, keys: list[str], order: list[str], out: str = "pos", limit: int = PIECE_ROWS,
) -> DataFrame:
    """Add the 0-based position of each row within its key; `order` must be unique within it."""
    ordinary, hot = split_hot(df, keys, limit, materialise=False)
    parts = []
    if ordinary is not None:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        parts.append(ordinary.withColumn(out, rank.cast("bigint") - 1))
    if hot is not None:
        parts.append(spread_position(hot, keys, order, out))
    return reduce(DataFrame.unionByName, parts)


def spread_position(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Positions by range partitions: rows before the partition plus the place within it.

    The range partitions are written with their number, since sampling again could cut elsewhere.
    """
    columns = [F.col(k) for k in keys] + [F.col(o) for o in order]
    pieces = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = checkpointed(
        df.repartitionByRange(pieces, *columns).withColumn("_piece", F.spark_partition_id()), "ranges"
    )
    sizes = placed.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_piece", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    # One row per key and partition it touches: hot keys plus partitions bound its size.
    joined = lookup_join(placed, starts, [*keys, "_piece"], how="inner", null_safe=True)
    rank = F.row_number().over(Window.partitionBy(*keys, "_piece").orderBy(*order))
    return joined.withColumn(out, F.col("_start") + rank - 1).drop("_piece", "_start")


def with_pieces(df: DataFrame, position: str, halo: int, rows: int = PIECE_ROWS) -> DataFrame:
    """Add `_piece` and `_halo`: rows near the end of a piece are repeated in the next one."""
    if halo >= rows:
        raise ValueError("the halo must be shorter than a piece")
    place = F.col(position) % rows
    copies = F.when(place >= rows - halo, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    return df.withColumn("_halo", F.explode(copies)).withColumn(
        "_piece", F.floor(F.col(position) / rows) + F.col("_halo").cast("bigint")
    )


