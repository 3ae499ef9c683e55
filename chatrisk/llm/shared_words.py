"""Values of words summed over documents.

Every document needs the value of each of its words, and the table of words grows with the corpus. The most
frequent words, a bounded number of bounded length, go to all tasks as a dictionary; the rest, few per
document, meet the table in a shuffle join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from chatrisk.llm.batches import byte_texts, map_batches
from chatrisk.plans.checkpoints import checkpointed

#: Words in the dictionary, and the longest word in it: 32 MB of words at most.
HOT_WORDS = 1 << 19
HOT_BYTES = 64
#: Distinct words that a task holds before it gives their counts away.
HELD_WORDS = 1 << 19

Words = Callable[[bytes], list[bytes]]


def word_counts(docs: DataFrame, words: Words, group: Callable[[object, int], int], groups: int) -> DataFrame:
    """(word, n0, n1, ..., n, total) over all texts of `docs` (doc_id, text, kind).

    `group` gives a document's group by id and kind; n0 and so on count the words of each group, n those of
    all groups, total also those of documents in none (-1). A task adds up before the shuffle.
    """
    schema = StructType([StructField("word", BinaryType()), StructField("group", IntegerType()), StructField("c", LongType())])

    def given(counters: list[Counter]) -> Iterator[pa.RecordBatch]:
        for number, counter in enumerate(counters):
            if counter:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(counter), pa.binary()), pa.array(np.full(len(counter), number - 1, np.int32)),
                     pa.array(list(counter.values()), pa.int64())],
                    names=schema.names,
                )
            counter.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [Counter() for _ in range(groups + 1)]
        for batch in batches:
            for doc_id, kind, text in zip(
                batch.column("doc_id").to_pylist(), batch.column("kind").to_pylist(), byte_texts(batch.column("text"))
            ):
                counters[group(doc_id, kind) + 1].update(words(text))
            if sum(map(len, counters)) > HELD_WORDS:
                yield from given(counters)
        yield from given(counters)

    found = docs.select("doc_id", "kind", "text").mapInArrow(count, schema)
    own = [F.sum(F.when(F.col("group") == g, F.col("c")).otherwise(F.lit(0))).alias(f"n{g}") for g in range(groups)]
    counts = found.groupBy("word").agg(*own, F.sum("c").alias("total"))
    return counts.withColumn("n", sum((F.col(f"n{g}") for g in range(groups)), F.lit(0).cast("bigint")))


def hot_words(values: DataFrame, columns: list[str]) -> tuple[dict[bytes, int], np.ndarray]:
    """Places of the most frequent words of `values` (word, total, columns), and their columns as an array.

    A histogram of frequencies gives the least frequency of which at most HOT_WORDS words exist.
    """
    short = values.filter(F.octet_length("word") <= HOT_BYTES)
    level = F.floor(F.log2(F.col("total").cast("double")) * 16).cast("int")
    histogram = sorted(short.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    limit, n = None, 0
    for row in histogram:
        if n + row["n"] > HOT_WORDS:
            break
        limit, n = row["level"], n + row["n"]
    if limit is None:
        return {}, np.zeros((0, len(columns)))
    table = short.filter(level >= limit).select("word", *columns).toArrow()
    places = {w: i for i, w in enumerate(table.column("word").to_pylist())}
    return places, np.stack([table.column(c).to_numpy().astype(float) for c in columns], axis=1).reshape(-1, len(columns))


def summed(docs: DataFrame, values: DataFrame, words: Words, columns: list[str], keep: list[str] = ["doc_id"]) -> DataFrame:
    """`docs` (doc_id, text) as the `keep` columns, n_words, n_bytes (a separator each included) and the sums of
    `columns` over the words of each text.

    `values` has each word of the texts once: word, total and the numeric columns.
    """
    places, known = hot_words(values, columns)
    rare = ArrayType(StructType([StructField("word", BinaryType()), StructField("n", IntegerType())]))
    fields = [
        StructField("row", LongType()), StructField("n_words", LongType()), StructField("n_bytes", LongType()),
        StructField("hot", ArrayType(DoubleType())), StructField("rare", rare),
    ]
    kind = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            sizes, lengths, sums, rest = [], [], [], []
            for text in byte_texts(batch.column("text")):
                own = words(text)
                at = np.fromiter(map(places.get, own, repeat(-1)), np.int64, len(own))
                missing = np.flatnonzero(at < 0)
                sizes.append(len(own))
                lengths.append(sum(map(len, own)) + len(own))
                sums.append(known[at[at >= 0]].sum(axis=0).tolist())
                rest.append([{"word": w, "n": n} for w, n in Counter([own[i] for i in missing.tolist()]).items()])
            rows = np.arange(row, row + len(sizes))
            row += len(sizes)
            yield batch, [
                pa.array(rows), pa.array(sizes, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.list_(pa.float64())), pa.array(rest, kind)
            ]

    found = checkpointed(map_batches(docs.select(*keep, "text"), look_up, fields, keep), "word-sums")
    pairs = found.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.n").alias("n"))
    more = pairs.join(values.select("word", *columns), "word").groupBy("row").agg(
        *[F.sum(F.col("n") * F.col(c)).alias(f"_{c}") for c in columns]
    )
    both = found.drop("rare").join(more, "row", "left")
    return both.select(
        *keep, "n_words", "n_bytes",
        *[(F.get("hot", F.lit(i)) + F.coalesce(f"_{c}", F.lit(0.0))).alias(c) for i, c in enumerate(columns)],
    )
