"""Near duplicates by chosen-path set similarity join over minwise sketches.

1. Every text gives its shingle set, a digest of the set, and a sketch of minwise values. Texts with equal
   sets form one class; from here on only classes are compared.
2. Several independent trees branch the classes: a node picks one of the sketch's coordinates by a hash of
   its path, sometimes a second one (1 / similarity on average), and classes with the same minwise token
   there go on together. A node of at most `NODE` classes is compared exhaustively by sketch; larger nodes
   compare all members with a few pivots and branch again.
3. Pairs whose sketches are near enough are confirmed on the full shingle sets, which are made again for the
   classes in question only. Confirmed pairs are links.
4. Nodes of more than `ALL_PAIRS` classes first propose a maximum spanning forest. When its links are known,
   only pairs between different components are proposed in a second round, by a finer sketch; nodes that are
   still too large after the last level are then compared in blocks, the largest component of the node against
   the rest. So no node is skipped, and a large group of copies costs little once it hangs together.

Null and empty texts have an empty set and are linked with nothing. Ids may repeat or be null: every row
keeps its own set. Extra columns are not needed and clash with nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from chatrisk.llm.batches import byte_texts, checked_join, map_batches, spaced
from chatrisk.llm.components import components
from chatrisk.plans.checkpoints import checkpointed

#: Minwise values in a sketch, and trees.
SKETCH = 128
TREES = 12
#: Classes compared exhaustively in one task; up to ALL_PAIRS, every near pair is proposed at once.
NODE = 1024
ALL_PAIRS = 32
LEVELS = 3
PIVOTS = 8
#: Nodes whose pivots are broadcast, at some 1.2 KB each.
PIVOT_ROWS = 50_000
#: A pair is confirmed on full sets if its sketch similarity is at most this far below the limit: 4.7
#: standard deviations at 0.85 and 128 values.
MARGIN = 0.15
#: Values of the finer sketch of the second round, of one byte each, and its margin (4.9 standard deviations).
FINE = 1024
FINE_MARGIN = 0.055

_MIX = np.uint64(0xFF51AFD7ED558CCD)
_MIX2 = np.uint64(0xC4CEB9FE1A85EC53)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(33)


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> _SHIFT)) * _MIX
    x = (x ^ (x >> _SHIFT)) * _MIX2
    return x ^ (x >> _SHIFT)


class WordCodes(dict):
    """64-bit codes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


def shingle_set(text: bytes, size: int, codes: WordCodes) -> np.ndarray:
    """Sorted distinct 64-bit codes of the shingles; fewer words than `size` are one shingle."""
    words = spaced(text)
    if not words:
        return np.empty(0, np.uint64)
    values = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    width = min(size, len(values))
    out = np.full(len(values) - width + 1, width, np.uint64)
    for k in range(width):
        out = mixed_bits(out * _ODD + values[k : len(values) - width + 1 + k])
    return np.unique(out)


class Sketcher:
    """Minwise values of a set under SKETCH random bijections, 32 bits each."""

    def __init__(self, size: int):
        seeds = mixed_bits(np.arange(1, 2 * size + 1, dtype=np.uint64) * _ODD)
        self.factors, self.masks = (seeds[:size] | np.uint64(1))[:, None], seeds[size:][:, None]

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factors), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(codes), 2048):
            part = codes[None, at : at + 2048] ^ self.masks
            part *= self.factors
            np.minimum(least, part.min(axis=1), out=least)
        return (least >> np.uint64(32)).astype(np.uint32)


def branches(paths: np.ndarray, sketches: np.ndarray, similarity: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, their new paths) for one chosen coordinate of each node and, for some nodes, a second one."""
    out, rows, size = [], np.arange(len(paths)), sketches.shape[1]
    second = mixed_bits(paths ^ np.uint64(0xA5)) < np.uint64((1 / similarity - 1) * 2**64)
    for turn, chosen in enumerate((np.ones(len(paths), bool), second)):
        own = paths[chosen]
        place = mixed_bits(own + np.uint64(turn)) % np.uint64(size)
        value = sketches[rows[chosen], place.astype(np.int64)].astype(np.uint64)
        out.append((rows[chosen], mixed_bits(mixed_bits(own * _ODD + place) + value)))
    return out


def _key(codes: np.ndarray) -> bytes:
    return hashlib.blake2b(codes.tobytes(), digest_size=16).digest()


def _id(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def set_rows(docs: DataFrame, shingle: int, similarity: float, trees: int = TREES, sketch: int = SKETCH) -> DataFrame:
    """doc_id, n_shingles, key (digest of the set; null if empty), sketch, tiny (its last bytes) and the paths of the
    first level."""
    fields = [
        StructField("n_shingles", LongType()), StructField("key", BinaryType()),
        StructField("sketch", BinaryType()), StructField("tiny", BinaryType()), StructField("paths", ArrayType(LongType())),
    ]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        codes, sketcher = WordCodes(), Sketcher(sketch)
        roots = mixed_bits(np.arange(1, trees + 1, dtype=np.uint64))
        for batch in batches:
            sets = [shingle_set(t, shingle, codes) for t in byte_texts(batch.column("text"))]
            sketches = [sketcher(s) if len(s) else None for s in sets]
            paths = []
            for values in sketches:
                if values is None:
                    paths.append(None)
                    continue
                own = branches(roots, np.broadcast_to(values, (trees, sketch)), similarity)
                paths.append(np.unique(np.concatenate([p for _, p in own]).view(np.int64)).tolist())
            yield batch, [
                pa.array([len(s) for s in sets], pa.int64()), pa.array([_key(s) if len(s) else None for s in sets], pa.binary()),
                pa.array([None if v is None else v.tobytes() for v in sketches], pa.binary()),
                pa.array([None if v is None else v.astype(np.uint8).tobytes() for v in sketches], pa.binary()), pa.array(paths, pa.list_(pa.int64())),
            ]

    return map_batches(docs.select("doc_id", "text"), rows, fields, ["doc_id"])


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, node: int = NODE, levels: int = LEVELS) -> DataFrame:
    """A row per row of `docs`: doc_id, n_shingles, key (of its set), group, component_id (smallest
    id reachable), kept.

    Documents with 100 * intersection >= percent * union of their shingle sets are linked.
    """
    rows, labels = linked_classes(docs, shingle, percent, node, levels)
    classes = rows.filter(F.col("key").isNotNull()).groupBy("key").agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")
    )
    groups = classes.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "component", F.coalesce("component", "key")
    )
    firsts = groups.groupBy("component").agg(
        F.min("first_id").alias("component_id"), F.sum("copies").alias("members")
    ).filter(F.col("members") > 1)
    shared = checkpointed(groups.join(firsts, "component").select("key", "component_id", F.col("component").alias("group")), "groups")
    found = checked_join(rows.select("doc_id", "n_shingles", "key"), shared, ["key"], "left")
    component = F.when(F.col("component_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select(
        "doc_id", "n_shingles", "key", F.coalesce("group", "key").alias("group"), component.alias("component_id"),
        component.eqNullSafe(F.col("doc_id")).alias("kept"),
    )


def deduplicated(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of `docs` per group: of the rows with the smallest id. Texts without words all stay.

    Rows are told apart by id. Of ids that several rows share, or that are null, the shingle sets are made
    again, and one row per id and set stays if the group's document has that id.
    """
    found = checkpointed(near_duplicates(docs, shingle, percent).withColumn("_id", _id()), "groups-of-rows")
    shared = found.groupBy("_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("doc_id").isNull()).alias("null")).filter(
        (F.col("n") > 1) | F.col("null")
    ).select("_id")
    shared = checkpointed(shared, "shared-ids")
    gone = checkpointed(found.filter(~F.col("kept")).select("_id").distinct(), "gone")
    own = docs.withColumn("_id", _id())
    plain = checked_join(checked_join(own, shared, ["_id"], "left_anti"), gone, ["_id"], "left_anti").drop("_id")
    if shared.isEmpty():
        return plain

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        codes = WordCodes()
        for batch in batches:
            sets = [shingle_set(t, shingle, codes) for t in byte_texts(batch.column("text"))]
            yield batch, [pa.array([_key(s) if len(s) else None for s in sets], pa.binary())]

    odd = map_batches(checked_join(own, shared, ["_id"], "left_semi"), keyed, [StructField("_key", BinaryType())], own.columns)
    # One set per group and id stays: of the sets that share the group's smallest id, the smallest.
    stays = (
        found.filter(F.col("kept") & F.col("key").isNotNull()).join(shared, "_id", "left_semi")
        .groupBy("_id", "component_id", "group").agg(F.min("key").alias("_key")).select("_id", "_key")
    )
    full = odd.filter(F.col("_key").isNotNull()).join(stays, ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"])
    return plain.unionByName(odd.filter(F.col("_key").isNull()).unionByName(full).drop("_id", "_key"))


def linked_classes(
    docs: DataFrame, shingle: int, percent: int, node: int = NODE, levels: int = LEVELS,
) -> tuple[DataFrame, DataFrame]:
    """The set rows of `docs`, and (node, component) of the classes that have a link."""
    similarity = percent / 100
    rows = checkpointed(set_rows(docs, shingle, similarity), "sets")
    # Rows of a class have equal paths; a task drops repeated ones before they are dealt out.
    members = rows.filter(F.col("key").isNotNull()).select("key", "paths").distinct().select("key", F.explode("paths").alias("path"))
    nodes, sketches, proposed, large = [], None, [], None
    for level in range(levels + 1):
        sizes = members.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        own = checkpointed(members.join(sizes, "path"), "nodes")
        if sketches is None:
            sketches = _sketches_of(rows, own)
        small, large = own.filter(F.col("n") <= node), own.filter(F.col("n") > node)
        nodes.append(small)
        if large.isEmpty():
            large = None
            break
        proposed.append(_pivot_pairs(large, sketches, similarity))
        if level < levels:
            members = _branched(large, sketches, similarity)
    smalls = reduce(DataFrame.unionByName, nodes)
    alone = smalls.select("path", "key", F.col("key").alias("component"), F.lit(0).alias("side"))
    proposed.append(_near_pairs(alone, sketches, similarity - MARGIN, "forest"))
    tested = checkpointed(reduce(DataFrame.unionByName, proposed).distinct(), "pairs")
    links = confirmed(docs, rows, tested, shingle, percent)
    wide = smalls.filter(F.col("n") > ALL_PAIRS)
    if wide.isEmpty() and large is None:
        return rows, components(links)
    labels = components(links)
    rest = _crossing(wide, labels).withColumn("side", F.lit(0)).withColumn("origin", F.col("path"))
    if large is not None:
        rest = rest.unionByName(_blocks(_crossing(large, labels), node))
    close = checkpointed(_near_pairs(rest, sketches, similarity - MARGIN, "members"), "close")
    fine = _fine_sketches(full_sets(docs, rows, close.select("key").distinct(), shingle))
    origins = close.groupBy("key").agg(F.collect_set("origin").alias("origins"))
    more = _near_pairs(close.join(origins, "key"), fine, similarity - FINE_MARGIN, "pairs").join(tested, ["a", "b"], "left_anti")
    more = checkpointed(more, "pairs")
    if more.isEmpty():
        return rows, labels
    return rows, components(links.unionByName(confirmed(docs, rows, more, shingle, percent)))


def _sketches_of(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, sketch, tiny) of the classes that share a node with another one."""
    firsts = rows.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min(_id()).alias("_id"))
    needed = checkpointed(firsts.join(nodes.select("key").distinct(), "key"), "needed")
    own = checked_join(rows.select("key", "sketch", "tiny", _id().alias("_id")), needed, ["key", "_id"], "inner")
    return checkpointed(own.dropDuplicates(["key"]).select("key", "sketch", "tiny"), "sketches")


def _branched(large: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            paths = batch.column("path").to_numpy(zero_copy_only=False).view(np.uint64)
            values = np.stack([np.frombuffer(s, np.uint32) for s in batch.column("sketch").to_pylist()])
            for rows, new in branches(paths, values, similarity):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(rows)), pa.array(new.view(np.int64))], names=["key", "path"]
                )

    schema = StructType([StructField("key", BinaryType()), StructField("path", LongType())])
    return large.select("path", "key").join(sketches.select("key", "sketch"), "key").mapInArrow(branch, schema).distinct()


def _pivot_pairs(large: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """Every class of large nodes against the PIVOTS smallest classes of the largest of its nodes, by sketch (tiny): one
    pair at most, with the nearest. What this leaves unlinked is compared in the second round."""
    # The digests are even, so this keeps some four times PIVOTS classes of a node before any are collected.
    first = F.conv(F.hex(F.substring("key", 1, 2)), 16, 10).cast("bigint") * F.col("n") <= PIVOTS * 4 * 65536
    few = large.filter(first).groupBy("path").agg(F.slice(F.sort_array(F.collect_set("key")), 1, PIVOTS).alias("pivots"))
    tiny = few.select("path", F.explode("pivots").alias("key")).join(sketches.select("key", "tiny"), "key")
    pivots = tiny.groupBy("path").agg(F.collect_list(F.struct("key", "tiny")).alias("pivots"))
    own = large.groupBy("key").agg(F.max(F.struct("n", "path")).alias("top")).select("key", F.col("top.path").alias("path"))
    own = own.join(sketches.select("key", "tiny"), "key")
    rated = checked_join(own, checkpointed(pivots, "pivots"), ["path"], "inner", PIVOT_ROWS).select("key", "tiny", "pivots")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for key, own_tiny, few_pivots in zip(*(c.to_pylist() for c in batch.columns)):
                others = [p for p in few_pivots if p["key"] != key]
                values = np.frombuffer(b"".join(p["tiny"] for p in others), np.uint8).reshape(len(others), SKETCH)
                alike = (values == np.frombuffer(own_tiny, np.uint8)).mean(axis=1)
                if len(others) and alike.max() >= similarity - MARGIN:
                    found.append((others[int(alike.argmax())]["key"], key))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.binary()) for i in (0, 1)], names=["a", "b"])

    schema = StructType([StructField("a", BinaryType()), StructField("b", BinaryType())])
    return rated.mapInArrow(rate, schema).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _crossing(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Nodes whose classes are in more than one component: path, key, component."""
    own = nodes.select("path", "key").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "component", F.coalesce("component", "key")
    )
    split = own.groupBy("path").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y")
    return checkpointed(own.join(split.select("path"), "path", "left_semi"), "crossing")


def _blocks(large: DataFrame, node: int) -> DataFrame:
    """Large nodes cut into pairs of blocks: the classes outside the node's largest component, in blocks,
    against each other and against blocks of that component; `origin` is the node's path."""
    counts = large.groupBy("path", "component").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("path").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all")).select(
        "path", F.col("top.component").alias("main"), F.ceil(F.col("top.n") * 2 / node).alias("mains"),
        F.ceil((F.col("all") - F.col("top.n")) * 2 / node).alias("rests"),
    )
    own = large.join(main, "path").withColumn("side", (F.col("component") != F.col("main")).cast("int"))
    place = F.pmod(F.xxhash64("key"), F.when(F.col("side") == 1, F.col("rests")).otherwise(F.col("mains")))
    own = own.withColumn("place", place)
    against_main = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(F.col("side") == 1, F.col("mains")).otherwise(F.col("rests")) - 1)))
    first = against_main.select(
        F.xxhash64("path", F.lit("main"), F.when(F.col("side") == 1, F.col("place")).otherwise(F.col("other")),
                   F.when(F.col("side") == 1, F.col("other")).otherwise(F.col("place"))).alias("path"), "key", "component", "side",
        F.col("path").alias("origin"),
    )
    among = own.filter("side = 1").withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rests") - 1)))
    second = among.select(
        F.xxhash64("path", F.lit("rest"), F.least("place", "other"), F.greatest("place", "other")).alias("path"),
        "key", "component", F.lit(0).alias("side"), F.col("path").alias("origin"),
    )
    return first.unionByName(second)


def _near_pairs(nodes: DataFrame, sketches: DataFrame, least: float, give: str) -> DataFrame:
    """Near pairs (a, b) of each node (path, key, component, side) between different components.

    Sketches (tiny) are compared by one byte per value, which adds 1/256 of a chance match. `give` is "pairs",
    "forest" (of nodes of more than ALL_PAIRS classes a maximum spanning forest) or "members", the rows of
    `nodes` that are in a near pair. For "pairs", a class's `origins` are the nodes it is in: a pair is given by the
    first node that both are in, not by every one.
    """
    names = ["path", "key", "component", "side", "origin"] if give == "members" else ["a", "b"]

    def near_ones(group: dict[str, list]) -> list[tuple[float, int, int]]:
        values = np.stack([np.frombuffer(s, np.uint8) for s in group["tiny"]])
        codes = np.unique(np.array(group["component"], object), return_inverse=True)[1]
        side = np.array(group["side"])
        near = []
        for i in range(len(values) - 1):
            alike = (values[i + 1 :] == values[i]).mean(axis=1)
            apart = (codes[i + 1 :] != codes[i]) & ((side[i] == 1) | (side[i + 1 :] == 1) | (not side.any()))
            near += [(float(alike[j]), i, i + 1 + j) for j in np.flatnonzero((alike >= least) & apart).tolist()]
        return near

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "path"):
            near = near_ones(group) if len(group["key"]) > 1 else []
            if give == "pairs":
                places = [set(o) for o in group["origins"]]
                near = [(x, i, j) for x, i, j in near if min(places[i] & places[j]) == group["origin"][0]]
            if not near:
                continue
            if give == "members":
                rows = sorted({i for _, *pair in near for i in pair})
                columns = [[group[c][i] for i in rows] for c in names]
                kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64()]
            else:
                if give == "forest" and len(group["key"]) > ALL_PAIRS:
                    near = _spanning(near, len(group["key"]))
                keys = [sorted((group["key"][i], group["key"][j])) for _, i, j in near]
                columns, kinds = list(zip(*keys)), [pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    kinds = {"path": LongType(), "side": IntegerType(), "origin": LongType()}
    schema = StructType([StructField(n, kinds.get(n, BinaryType())) for n in names])
    joined = nodes.join(sketches.select("key", "tiny"), "key").select(*nodes.columns, "tiny")
    found = joined.repartition("path").sortWithinPartitions("path", "key").mapInArrow(run, schema)
    return found if give == "members" else found.distinct()


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, list]]:
    """The rows of each value of a sorted column, as lists by column."""
    held: dict[str, list] = {}
    current = None
    for batch in batches:
        columns = batch.to_pydict()
        values = columns[key]
        starts = [i for i in range(len(values)) if i == 0 or values[i] != values[i - 1]] + [len(values)]
        for a, b in zip(starts, starts[1:]):
            part = {c: v[a:b] for c, v in columns.items()}
            if held and values[a] == current:
                held = {c: held[c] + part[c] for c in held}
            else:
                if held:
                    yield held
                held, current = part, values[a]
    if held:
        yield held


def _spanning(near: list[tuple[float, int, int]], n: int) -> list[tuple[float, int, int]]:
    above = list(range(n))

    def top(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    out = []
    for edge in sorted(near, reverse=True):
        a, b = top(edge[1]), top(edge[2])
        if a != b:
            above[a] = b
            out.append(edge)
    return out


def full_sets(docs: DataFrame, rows: DataFrame, keys: DataFrame, shingle: int) -> DataFrame:
    """(key, codes) of some classes, made again from the text of one document each."""
    firsts = rows.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min(_id()).alias("_id"))
    needed = checkpointed(firsts.join(keys, "key").select("_id").distinct(), "ids")
    texts = checked_join(docs.select(_id().alias("_id"), "text"), needed, ["_id"], "left_semi")

    def remade(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        codes = WordCodes()
        for batch in batches:
            sets = [shingle_set(t, shingle, codes) for t in byte_texts(batch.column("text"))]
            yield batch, [
                pa.array([_key(s) if len(s) else None for s in sets], pa.binary()),
                pa.array([s.tobytes() for s in sets], pa.binary()),
            ]

    sets = map_batches(texts, remade, [StructField("key", BinaryType()), StructField("codes", BinaryType())], [])
    return checkpointed(sets.filter(F.col("key").isNotNull()), "full-sets").dropDuplicates(["key"])


def _fine_sketches(sets: DataFrame) -> DataFrame:
    """(key, tiny) with FINE values instead of SKETCH."""
    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        sketcher = Sketcher(FINE)
        for batch in batches:
            values = [sketcher(np.frombuffer(c, np.uint64)) for c in batch.column("codes").to_pylist()]
            yield batch, [pa.array([v.astype(np.uint8).tobytes() for v in values], pa.binary())]

    return checkpointed(map_batches(sets, sketched, [StructField("tiny", BinaryType())], ["key"]), "fine-sketches")


def confirmed(docs: DataFrame, rows: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets meet the limit."""
    keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    sets = full_sets(docs, rows, keys, shingle)
    left = pairs.join(sets.select(F.col("key").alias("a"), F.col("codes").alias("x")), "a")
    both = left.join(sets.select(F.col("key").alias("b"), F.col("codes").alias("y")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.filter(pa.array(linked, pa.bool_())).select(["a", "b"])

    schema = StructType([StructField("a", BinaryType()), StructField("b", BinaryType())])
    return checkpointed(both.select("a", "b", "x", "y").mapInArrow(check, schema), "links")
