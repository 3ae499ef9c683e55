"""Hard-negative mining by a secondary-sort shuffle of packed score keys.

1. Vectors become integers and are packed into blocks of bounded size. Blocks of anchors (the stated query set) meet
   blocks of all rows, and a task scores one pair of blocks by a matrix product; scores stay in the task.
2. A first pass keeps, per anchor and block, the best rows of the anchor's label; the best of those are its positives.
3. A second pass opens the windows of these positives and keeps, per anchor, window and block, the first rows of other
   labels inside. Nothing else can be among the first ones of all blocks, so this pre-aggregation loses no row.
4. Every positive and every row that is left becomes a key (anchor, descending score, kind, id) of 25 bytes whose byte
   order is the order wanted. repartitionAndSortWithinPartitions deals the keys out by anchor and sorts them; an
   iterator reads an anchor's keys once, opens a window when a positive passes and emits the negatives of each open
   window until it is full. It holds the open windows only, never the anchor's rows.

Rows with a null id, label or vector, or with a null or non-finite component (256-fold included), take no part. Of rows
that share an id the one with the smallest label, then the smallest vector, counts. A shorter vector counts as filled
up with zeros. Scores beyond BIGINT are held at its ends. Anchors without positives give no rows; empty tables give an
empty result. Only the named columns are read, so others clash with nothing.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatrisk.plans.checkpoints import checkpointed

#: Rows of a block; a pair of blocks is scored at once.
BLOCK = 1024
#: Blocks of rows that get one copy of the anchors.
SPREAD = 32
SCALE = 256
#: Sums of products up to here are exact in double precision.
_EXACT = 2**53
_LONG = (-(2**63), 2**63 - 1)
_KEY = ">QQBQ"


def prepared(rows: DataFrame, row_id: Column, label: Column, vector: Column, scale: int = SCALE) -> DataFrame:
    """vec_id, label and vector (of doubles) of the rows that take part."""
    own = rows.select(row_id.cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), vector.cast("array<double>").alias("vector"))
    scaled = F.transform("vector", lambda x: x * F.lit(float(scale)))
    fine = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = own.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).filter(fine)
    return kept.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("v")).select("vec_id", "v.label", "v.vector")


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of a partition in batches of `size`, the last one smaller."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - n)
            held, n, batch = [*held, part], n + part.num_rows, batch.slice(part.num_rows)
            if n == size:
                yield pa.concat_batches(held)
                held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def blocks(rows: DataFrame, scale: int, size: int = BLOCK, windows: bool = False) -> DataFrame:
    """Rows packed into blocks in order of id: block (a number), ids, labels, vectors as bytes, and the width."""
    schema = "block bigint, ids binary, labels binary, vectors binary, width int" + ", lows binary, highs binary" * windows

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, size):
            batch = batch.take(pc.sort_indices(batch.column("vec_id")))
            lists = batch.column("vector")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            values = np.zeros((len(sizes), int(sizes.max())))
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            places = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            values[np.repeat(np.arange(len(sizes)), sizes), places] = np.floor(flat * scale)
            small = not values.size or np.abs(values).max() < 2**15
            ids = batch.column("vec_id").to_numpy()
            columns = [
                [int(ids[0])], [ids.tobytes()], [batch.column("label").to_numpy().tobytes()],
                [(b"s" if small else b"d") + values.astype("<i2" if small else "<f8").tobytes()], [values.shape[1]],
            ]
            if windows:
                columns += [[np.array(batch.column(c).to_pylist(), np.int64).tobytes()] for c in ("lows", "highs")]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in schema.split(", ")]
            )

    return rows.mapInArrow(pack, schema)


def met(anchors: DataFrame, rows: DataFrame, n_blocks: int, spread: int = SPREAD) -> DataFrame:
    """Every block of anchors beside every block of rows.

    Rows are dealt out by block once; the anchors, the query set, are copied once for every `spread` blocks of rows.
    """
    parts = max(1, -(-n_blocks // spread), min(n_blocks, rows.sparkSession.sparkContext.defaultParallelism))
    copies = anchors.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    own = rows.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int"))
    windows = [F.col(f"x.{c}") for c in ("lows", "highs") if c in anchors.columns]
    return own.alias("r").join(copies.alias("x"), "part").select(
        *[F.col(f"x.{c}").alias(f"a_{c}") for c in ("ids", "labels", "vectors", "width")], *windows,
        *[F.col(f"r.{c}") for c in ("ids", "labels", "vectors", "width")],
    )


def _vectors(data: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(data, "<i2" if data[:1] == b"s" else "<f8", offset=1).reshape(n, width).astype(np.float64)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices, exact, as 64-bit numbers."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if not width:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * width < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.array([[int(x) for x in row] for row in a], object) @ np.array([[int(x) for x in row] for row in b], object).T
    return np.array([[min(max(x, _LONG[0]), _LONG[1]) for x in row] for row in whole.tolist()], np.int64)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Scored pairs of blocks, a part of the anchors at a time."""
    for batch in batches:
        for row in batch.to_pylist():
            a_ids, a_labels, ids, labels = (np.frombuffer(row[c], np.int64) for c in ("a_ids", "a_labels", "ids", "labels"))
            a, b = _vectors(row["a_vectors"], len(a_ids), row["a_width"]), _vectors(row["vectors"], len(ids), row["width"])
            for at in range(0, len(a_ids), 128):
                part = slice(at, at + 128)
                found = {"a_ids": a_ids[part], "ids": ids, "scores": scores(a[part], b)}
                found["alike"] = a_labels[part, None] == labels[None, :]
                found["own"] = a_ids[part, None] == ids[None, :]
                for c in ("lows", "highs"):
                    if c in row:
                        found[c] = np.frombuffer(row[c], np.int64).reshape(len(a_ids), -1)[part]
                yield found


def positives(anchors: DataFrame, rows: DataFrame, n_blocks: int, n: int) -> DataFrame:
    """anchor_id, positive_id, score of each anchor's first n other rows of its label."""
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _pairs(batches):
            score, fit = x["scores"], x["alike"] & ~x["own"]
            out = []
            for k in np.flatnonzero(fit.any(axis=1)).tolist():
                at = np.flatnonzero(fit[k])
                at = at[np.argsort(~score[k, at], kind="stable")[:n]]
                out.append((np.full(len(at), x["a_ids"][k]), x["ids"][at], score[k, at]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["anchor_id", "positive_id", "score"])

    found = met(anchors, rows, n_blocks).mapInArrow(best, "anchor_id bigint, positive_id bigint, score bigint")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    return found.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= n).drop("at")


def _flipped(value: int) -> int:
    """A signed number as an unsigned one of the same order."""
    return value + 2**63


def packed(anchor: int, score: int, row_id: int, positive: bool) -> bytes:
    """A key whose byte order is: anchor, score descending, positives first, id."""
    return struct.pack(_KEY, _flipped(anchor), 2**64 - 1 - _flipped(score), 0 if positive else 1, _flipped(row_id))


def unpacked(key: bytes) -> tuple[int, int, int, bool]:
    anchor, score, kind, row_id = struct.unpack(_KEY, key)
    return anchor - 2**63, 2**63 - 1 - score, row_id - 2**63, not kind


def spread_anchor(key: bytes) -> int:
    """A partition number from the anchor alone; ids that step by a fixed number spread too."""
    return (int.from_bytes(key[:8], "big") * 0x9E3779B97F4A7C15 >> 20) & 0xFFFFFFFF


def window_keys(anchors: DataFrame, rows: DataFrame, n_blocks: int, n: int) -> DataFrame:
    """`key`s of the rows of other labels that are among the first n of a window in their block."""
    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _pairs(batches):
            fit = ~x["alike"] & ~x["own"]
            # Others sort behind all that fit; equal scores keep the order of ids.
            order = np.lexsort((~x["scores"], ~fit), axis=1)
            score, n_fit = np.take_along_axis(x["scores"], order, 1), fit.sum(axis=1)
            place = np.arange(score.shape[1])[None, :]
            real = place < n_fit[:, None]
            chosen = np.zeros(score.shape, bool)
            for w in range(x["lows"].shape[1]):
                low, high = x["lows"][:, w, None], x["highs"][:, w, None]
                first = (real & (score > high)).sum(axis=1)[:, None]
                chosen |= real & (place >= first) & (place < first + n) & (score >= low) & (score <= high)
            k, at = np.nonzero(chosen)
            ids = x["ids"][order[k, at]].tolist()
            keys = [packed(a, s, i, False) for a, s, i in zip(x["a_ids"][k].tolist(), score[k, at].tolist(), ids)]
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], names=["key"])

    return met(anchors, rows, n_blocks).mapInArrow(inside, "key binary")


def bounds(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and the greatest integer score from low to high percent of a positive's score."""
    return -(-low * score // 100), high * score // 100


def stream(keys: Iterable[bytes], n: int, low: int, high: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """The result rows of sorted keys, read once; an anchor's open windows are all that is held."""
    current, windows = None, []
    for key in keys:
        anchor, score, row_id, positive = unpacked(key)
        if anchor != current:
            current, windows = anchor, []
        if positive:
            windows.append([row_id, score, *bounds(score, low, high), 0])
            continue
        for window in windows:
            if window[2] <= score <= window[3] and window[4] < n:
                window[4] += 1
                yield anchor, window[0], window[4], row_id, window[1], score


def mined(
    rows: DataFrame, is_anchor: Column, *, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90,
    scale: int = SCALE, block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from `prepared` rows.

    A row's score is its inner product with the anchor; higher ones come first, ties by smaller id. An anchor's
    positives are its first `n_positives` other rows of its label; for each the first `n_negatives` rows of other labels
    with low * positive_score <= 100 * score <= high * positive_score.
    """
    if not 0 <= low < high <= 100:
        raise ValueError("windows reach from low to high percent, 0 to 100")
    spark = rows.sparkSession
    rows = checkpointed(rows, "vectors")
    packs = checkpointed(blocks(rows, scale, block), "blocks")
    n_blocks = packs.count()
    asked = checkpointed(rows.filter(is_anchor), "anchors")
    best = checkpointed(positives(blocks(asked, scale, block), packs, n_blocks, n_positives), "positives")

    # A negative score has no window: low percent of it are more than high percent. 1 to 0 holds nothing.
    score = F.col("score")
    whole, rest = F.expr("score DIV 100"), score % 100
    low_end = F.when(score < 0, 1).otherwise(whole * low + F.ceil(rest * low / 100))
    high_end = F.when(score < 0, 0).otherwise(whole * high + F.floor(rest * high / 100))
    ends = best.groupBy("anchor_id").agg(F.collect_list(low_end).alias("lows"), F.collect_list(high_end).alias("highs"))

    def filled(c: str, value: int) -> Column:
        return F.concat(c, F.array_repeat(F.lit(value).cast("bigint"), n_positives - F.size(c))).alias(c)

    opened = asked.join(ends, asked.vec_id == ends.anchor_id).select("vec_id", "label", "vector", filled("lows", 1), filled("highs", 0))
    negatives = window_keys(blocks(opened, scale, block, windows=True), packs, n_blocks, n_negatives)

    pairs = best.rdd.map(lambda r: (packed(r[0], r[2], r[1], True), None)).union(negatives.rdd.map(lambda r: (bytes(r[0]), None)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_keys = pairs.repartitionAndSortWithinPartitions(parts, spread_anchor)
    out = sorted_keys.mapPartitions(lambda part: stream((key for key, _ in part), n_negatives, low, high))
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    return spark.createDataFrame(out, schema, verifySchema=False)
