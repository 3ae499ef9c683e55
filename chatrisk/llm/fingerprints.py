"""SimHash near duplicates by covering locality-sensitive hashing.

1. A document's fingerprint has the bits that are set in more than half of the 64-bit hashes of its word shingles,
   repeats included. Documents of one fingerprint form a class; from here on only distinct fingerprints are handled.
2. Every bit position gets a nonzero vector of radius + 1 bits, and every nonzero vector v of that length a table, whose
   mask holds the positions with an odd number of common bits with v. Positions in which two fingerprints differ have at
   most `radius` vectors, so some v is orthogonal to all of them: in its table the pair agrees on the whole mask.
   No pair within the radius is missed, and there are no further tables.
3. Fingerprints that meet in a bucket of up to BUCKET are compared directly; only true links leave the bucket. In a
   larger bucket nothing is compared: each fingerprint is sent to all points within half the radius of it (outside the
   mask, where the bucket's members can differ). Two fingerprints within the radius share such a point, and all that
   share a point are within the radius; their number has a bound, and each is linked with the smallest.
4. Components of the links, as the smallest doc_id of the classes in them.

A null text is empty. Texts without words have the fingerprint zero, linked like any other. Ids may repeat or be null:
every row keeps its fingerprint; null ids are never the smallest, and a component of null ids only has a null id.
Only `doc_id` and `text` are read, so other columns clash with nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from chatrisk.llm.batches import byte_texts, checked_join, map_batches, spaced
from chatrisk.llm.components import components
from chatrisk.plans.checkpoints import checkpointed

BITS = 64
SEED = 42
#: Buckets of up to this many distinct fingerprints are compared directly.
BUCKET = 64
#: Shingles hashed before their bits are counted.
_SHINGLES = 1 << 16


def fingerprint(text: bytes, shingle: int) -> int:
    """The majority bits of the shingle hashes as an unsigned number; 0 without words."""
    words = spaced(text)
    if not words:
        return 0
    width = min(shingle, len(words))
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    stops = ends[width - 1 :].tolist()
    counts, n = np.zeros(BITS, np.int64), len(starts)
    for at in range(0, n, _SHINGLES):
        parts = map(line.__getitem__, map(slice, starts[at : at + _SHINGLES], stops[at : at + _SHINGLES]))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, min(_SHINGLES, n - at))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and `bits`, the fingerprint as a signed number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for batch in batches:
            values = [fingerprint(t, shingle) for t in byte_texts(batch.column("text"))]
            yield batch, [pa.array(np.array(values, np.uint64).view(np.int64))]

    return map_batches(docs.select("doc_id", "text"), run, [StructField("bits", LongType())], ["doc_id"])


def masks(radius: int) -> list[int]:
    """The covering masks of the radius: 2^(radius + 1) - 1 of them, as unsigned numbers."""
    vectors = [1 + position % ((1 << radius + 1) - 1) for position in range(BITS)]
    return [
        sum(1 << position for position, m in enumerate(vectors) if (m & v).bit_count() % 2)
        for v in range(1, 1 << radius + 1)
    ]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >= 1 << BITS - 1 else value


def bucketed(classes: DataFrame, radius: int) -> DataFrame:
    """(bits, mask, part, n) of the fingerprints that are not alone in a bucket; n is the bucket's size."""
    tables = F.explode(F.array(*[F.lit(_signed(m)) for m in masks(radius)]))
    members = classes.select("bits", tables.alias("mask")).withColumn("part", F.col("bits").bitwiseAND(F.col("mask")))
    sizes = members.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return members.join(sizes, ["mask", "part"])


def direct_links(small: DataFrame, radius: int) -> DataFrame:
    """Links in small buckets, by comparing each with the larger ones of its bucket."""
    groups = small.groupBy("mask", "part").agg(F.collect_set("bits").alias("members"))

    def near(x: Column) -> Column:
        others = F.filter("members", lambda y: (y > x) & (F.bit_count(x.bitwiseXOR(y)) <= radius))
        return F.transform(others, lambda y: F.struct(x.alias("a"), y.alias("b")))

    return groups.select(F.explode(F.flatten(F.transform("members", near))).alias("link")).select("link.*")


def _flips(n: int, free: Column) -> Column:
    """All ways to flip up to n of the bits of `free`, as a column of numbers to exclude-or with."""
    bits = F.filter(F.array(*[F.lit(_signed(1 << k)) for k in range(BITS)]), lambda b: b.bitwiseAND(free) != 0)
    ways = F.array(F.lit(0).cast("bigint"))
    for _ in range(n):
        known = ways
        more = F.flatten(F.transform(known, lambda w: F.transform(bits, lambda b: w.bitwiseOR(b))))
        ways = F.array_distinct(F.concat(known, more))
    return ways


def meeting_links(large: DataFrame, radius: int) -> DataFrame:
    """Links in large buckets by common points: rows grow with the bucket, not with its square.

    For an odd radius the points lie half a bit farther, so those that share one are compared.
    """
    far = (radius + 1) // 2
    points = large.select("bits", F.explode(_flips(far, F.bitwise_not("mask"))).alias("way"))
    met = points.select("bits", F.col("bits").bitwiseXOR(F.col("way")).alias("point")).distinct()
    if radius % 2 == 0:  # all that share a point are within the radius
        first = met.groupBy("point").agg(F.min("bits").alias("a"), F.max("bits").alias("z")).filter("a < z").select("point", "a")
        return met.join(first, "point").filter("a < bits").select("a", F.col("bits").alias("b"))
    return direct_links(met.select("bits", F.lit(0).alias("mask"), F.col("point").alias("part")), radius)


def near_fingerprints(docs: DataFrame, shingle: int = 3, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for every row of `docs`."""
    rows = checkpointed(fingerprints(docs, shingle), "fingerprints")
    classes = rows.groupBy("bits").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    classes = checkpointed(classes, "classes")
    members = checkpointed(bucketed(classes, radius), "buckets")
    links = direct_links(members.filter(F.col("n") <= bucket), radius)
    large = members.filter(F.col("n") > bucket)
    if not large.isEmpty():
        links = links.unionByName(meeting_links(large, radius))
    labels = components(links)
    grouped = classes.join(labels.withColumnRenamed("node", "bits"), "bits", "left").withColumn(
        "component", F.coalesce("component", "bits")
    )
    firsts = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"), F.sum("copies").alias("members"))
    shared = grouped.join(firsts.filter("members > 1"), "component").select("bits", "component_id", F.lit(True).alias("shared"))
    found = checked_join(rows, checkpointed(shared, "components"), ["bits"], "left")
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"),
        F.when(F.col("shared"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
