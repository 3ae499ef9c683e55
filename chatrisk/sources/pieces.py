"""Ordered scans of text files whose records do not end with lines.

A file is read in pieces between occurrences of a separator, by as many tasks as the file has splits. What a piece
means depends on what stands before it, so a scan goes twice over the pieces: the first pass sums up every split in one
narrow row, windows over those rows give the state at the start of every split, and the second pass reads with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatrisk.plans.checkpoints import checkpointed

#: Splits whose start states are broadcast: 128 TB in splits of 128 MB.
MOST_SPLITS = 1_000_000
SPLIT = ["file", "block"]


def read_pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """file, block (first byte of the split) and value; the pieces of a split are adjacent and in order."""
    raw = spark.read.option("lineSep", separator).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def earlier(*keys: str) -> Window:
    """All splits of a file before this one; a row per split, so the window is narrow."""
    return Window.partitionBy(*(keys or ("file",))).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def per_split(
    pieces: DataFrame, function: Callable[..., Iterator[tuple]], schema: str, extra: list[str] | None = None,
) -> DataFrame:
    """Rows that `function(first, texts, *extra values)` gives for every split, with its file and block.

    `first` tells that the split's first piece begins its file. Pieces pass through one at a time.
    """
    names = [part.split()[0] for part in schema.split(", ")]
    columns = [*SPLIT, "value", *(extra or [])]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(column.to_pylist() for column in batch.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (file, block), own in groupby(rows(batches), key=lambda r: r[:2]):
            head = next(own)
            texts = (r[2] for r in _chained(head, own))
            for found in function(block == 0, texts, *head[3:]):
                out.append((file, block, *found))
                if len(out) == 1024:
                    yield _batch(out, target)
                    out = []
        if out:
            yield _batch(out, target)

    whole = f"file STRING, block BIGINT, {schema}"
    target = _arrow_schema(pieces.sparkSession, whole)
    assert target.names == [*SPLIT, *names]
    return pieces.select(*columns).mapInArrow(run, whole)


def _chained(head: tuple, rest: Iterator[tuple]) -> Iterator[tuple]:
    yield head
    yield from rest


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    kinds = {"STRING": pa.string(), "BIGINT": pa.int64(), "INT": pa.int32(), "BOOLEAN": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in schema.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), schema.types)], schema=schema)


def with_starts(pieces: DataFrame, starts: DataFrame) -> DataFrame:
    """Pieces with the state at the start of their split; a split that was not there in the first pass is an error."""
    if starts.count() > MOST_SPLITS:
        raise ValueError(f"more than {MOST_SPLITS} splits: raise spark.sql.files.maxPartitionBytes")
    known = F.broadcast(starts.withColumn("_known", F.lit(True)))
    joined = pieces.join(known, SPLIT, "left")
    check = F.when(F.col("_known").isNull(), F.raise_error(F.lit("the files' splits changed between two passes"))).otherwise(F.col("block"))
    return joined.withColumn("block", check.cast("bigint")).drop("_known")


def summed_up(pieces: DataFrame, function: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """The first pass, written: a row per split."""
    return checkpointed(per_split(pieces, function, schema), "splits")
