"""Arrow batches in and out of Python tasks, and the byte forms of words.

Texts reach Python as UTF-8 bytes. ASCII letters, digits and white space are single bytes there, and
every other character consists of bytes from 0x80, so byte tables express the word rules exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from chatrisk.plans.joins import BROADCAST_ROWS, fits_broadcast

#: Rows sent to Python at once; a batch holds this many whole texts.
BATCH_ROWS = 512


def _letters_and_digits() -> bytes:
    table = bytearray(b" " * 256)
    for c in range(256):
        if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A:
            table[c] = c
        elif 0x41 <= c <= 0x5A:
            table[c] = c + 32
    return bytes(table)


#: Lower-cases A-Z and turns every byte that is not a letter, a digit or above 0x7F into a space.
PLAIN = _letters_and_digits()


def tuned(spark: SparkSession) -> SparkSession:
    """Settings the operators of this subpackage are written for."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def spaced(text: bytes) -> list[bytes]:
    """Lower-cased words between ASCII white space (0x20, 0x09-0x0D)."""
    return text.lower().split()


def plain(text: bytes) -> list[bytes]:
    """Lower-cased words of letters, digits and characters above 0x7F."""
    return text.translate(PLAIN).split()


def byte_texts(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes; a null text is empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def map_batches(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list[pa.Array]]]],
    fields: list[StructField], keep: list[str],
) -> DataFrame:
    """`keep` columns of `df` with new columns beside them.

    `function` gets all batches of a partition and yields each with its new columns. A kept column whose
    name a new one also has gives way to it.
    """
    new = {f.name for f in fields}
    stay = [c for c in keep if c not in new]
    schema = StructType([df.schema[c] for c in stay] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, columns in function(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in stay] + columns, names=stay + [f.name for f in fields]
            )

    return df.mapInArrow(run, schema)


def checked_join(big: DataFrame, small: DataFrame, on: list[str], how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast join up to a counted size, beyond it a shuffle join that Spark splits where it is skewed."""
    return big.join(F.broadcast(small) if fits_broadcast(small, limit) else small, on, how)


def kept_rows(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that meet a costly condition, which is evaluated where it stands.

    A plain filter is pushed below the projections that the condition is made of, and repeats them, inside
    their own lambdas too. A row number in the tested value keeps it in place.
    """
    return df.withColumn("_stays", F.when(condition, F.monotonically_increasing_id())).filter("_stays IS NOT NULL").drop("_stays")
