"""Benchmark decontamination: n-gram windows of the benchmark, found in training texts and cut out.

The windows of a bounded part of the benchmark form a hash set that goes to every task. A task slides
over the words of its documents with a rolling hash, looks the hashes up, and verifies each hit word by
word. A benchmark beyond the bound is handled in several passes, each with its own part.

Nulls and texts without words have no window and no hit. Items with the same text each count, an
item id counts once; repeated documents each give a row. Extra columns pass through; columns named like a result give way to it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from chatrisk.llm.batches import PLAIN, byte_texts, map_batches, plain
from chatrisk.plans.checkpoints import checkpointed

WINDOW = 10
#: Bytes of benchmark text whose windows are sent to the tasks in one pass.
PASS_BYTES = 32 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)

SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
FIELDS = [
    StructField("n_words", LongType()), StructField("hit_spans", SPANS), StructField("hit_items", ArrayType(LongType())),
]


class Windows:
    """Windows of benchmark texts: per length the sorted hashes, and per window the items that have it."""

    def __init__(self, items: list[tuple[int, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        texts: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for item, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in plain(text))
            if ids:
                texts[ids].append(item)
        self.items = list(texts.values())
        self.owners: dict[int, dict[tuple[int, ...], set[int]]] = defaultdict(lambda: defaultdict(set))
        for number, ids in enumerate(texts):
            length = min(window, len(ids))
            for i in range(len(ids) - length + 1):
                self.owners[length][ids[i : i + length]].add(number)
        self.owners = {n: dict(w) for n, w in self.owners.items()}
        self.hashes = {
            n: np.unique(np.concatenate([_rolling(np.array(w, np.uint64), n) for w in windows]))
            for n, windows in self.owners.items()
        }

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged word spans covered by windows, and the numbers of the texts they come from."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.uint64, len(words))
        known = np.concatenate([[0], np.cumsum(ids != 0)])
        found: list[tuple[int, int]] = []
        owners: set[int] = set()
        for n, hashes in self.hashes.items():
            if len(words) < n:
                continue
            places = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(places):
                continue
            rolled = _rolling(ids, n)[places]
            near = np.minimum(np.searchsorted(hashes, rolled), len(hashes) - 1)
            for p in places[hashes[near] == rolled].tolist():
                own = self.owners[n].get(tuple(ids[p : p + n].tolist()))
                if own is not None:
                    found.append((p, p + n))
                    owners |= own
        return _merged(found), owners


def _rolling(ids: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        out = out * _FACTOR + ids[k : len(ids) - n + 1 + k]
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """`docs` with n_words, hit_spans (word positions, merged, end exclusive) and hit_items (sorted item ids).

    A span covers the words of every benchmark window that occurs in the text; items shorter than a
    window are one window. The benchmark is counted first and read in parts of about `pass_bytes`.
    """
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-size // pass_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    columns = [c for c in docs.columns if c not in {f.name for f in FIELDS}]
    found = docs.select(*columns)
    for number in range(passes):
        rows = benchmark.filter(part == number).select("item_id", "text").collect()
        items = [(r[0], r[1].encode()) for r in rows if r[1] is not None]
        found = _scan(found, Windows(items, window), columns, first=number == 0)
        if passes > 1:
            found = checkpointed(found, "decontaminate")
    return found


def _scan(docs: DataFrame, windows: Windows, columns: list[str], first: bool) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for batch in batches:
            sizes, spans, items = [], [], []
            for row, text in enumerate(byte_texts(batch.column("text"))):
                words = plain(text)
                hits, owners = windows.find(words)
                own = {i for o in owners for i in windows.items[o]}
                if not first:
                    before = batch.column("hit_spans")[row].as_py()
                    hits = _merged(hits + [(s["start"], s["end"]) for s in before])
                    own |= set(batch.column("hit_items")[row].as_py())
                sizes.append(len(words))
                spans.append([{"start": s, "end": e} for s, e in hits])
                items.append(sorted(own, key=lambda i: (i is None, i or 0)))
            kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield batch, [pa.array(sizes, pa.int64()), pa.array(spans, kinds), pa.array(items, pa.list_(pa.int64()))]

    return map_batches(docs, scan, FIELDS, columns)


def with_digest(found: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated from the spans and items."""
    hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    ids = F.array_join(F.array_sort(F.transform("hit_items", lambda i: i.cast("string"))), ",")
    new = ("n_hit", "n_items", "items_sha256", "contaminated")
    return found.select(
        *[c for c in found.columns if c not in new], hit.alias("n_hit"), F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"),
    )


def remove_spans(found: DataFrame, drop_share: float = 0.5) -> DataFrame:
    """Cut the hit words out of the texts; documents with more than `drop_share` of their words hit go.

    A cut runs from the start of its first word to the end of its last and leaves a line break. The rest
    of the text is unchanged. Texts without hits pass unchanged, null and empty ones included.
    """
    hit = F.aggregate("hit_spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    kept = found.filter((hit == 0) | (hit <= F.col("n_words") * drop_share))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for batch in batches:
            spans = batch.column("hit_spans").to_pylist()
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            yield batch, [pa.array([_cut(t, s) if s else t for t, s in zip(texts, spans)], pa.binary()).cast(pa.string())]

    names = [c for c in found.columns if c not in ("n_words", "hit_spans", "hit_items")]
    cleaned = map_batches(kept, cut, [StructField("_clean_text", StringType())], names)
    return cleaned.withColumn("text", F.col("_clean_text")).select(*names)


def _cut(text: bytes, spans: list[dict]) -> bytes:
    marks = np.frombuffer(b" " + text.translate(PLAIN) + b" ", np.uint8) == 32
    starts = np.flatnonzero(marks[:-1] & ~marks[1:])
    ends = np.flatnonzero(~marks[:-1] & marks[1:])
    out, at = [], 0
    for s in spans:
        out.append(text[at : starts[s["start"]]])
        at = int(ends[s["end"] - 1])
    return b"\n".join([*out, text[at:]])
