"""Alignment of two tokenizers by interval coalescing over byte offsets.

1. A text is cut before every single space between two characters that are not white space. No token of either
   vocabulary crosses such a cut, so each segment is encoded on its own, and a worker encodes a repeated segment once.
2. The tokens of all new segments, both sides together, lie on one byte axis. They are sorted by start, the running
   maximum of their ends is taken, and a group breaks where a start reaches it. Within a group every A token is
   linked with every B token.
3. Documents are handled in chunks. A chunk has a dictionary of its id pairs with the number of its documents that
   hold each, and its documents refer to that dictionary. Dictionaries are added up to corpus counts, and every
   chunk gets back the counts of its own dictionary: documents themselves are never exploded into pairs.

A null or empty text, or one whose token bytes on either side do not give back a space and the text, has no tokens:
all its numbers are zero and its digest is ''. Ids may repeat or be null, every row is a document of its own; an
empty table gives an empty result; of the input only `doc_id` and `text` are read, so other columns clash with nothing.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatrisk.plans.checkpoints import checkpointed
from chatrisk.plans.workers import once_per_worker

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: A chunk ends with the first document that brings it to so many characters, or to so many documents.
CHUNK_CHARS = 16_000_000
CHUNK_DOCS = 65_536
#: A worker forgets its segments when there are more than this, or more characters of digests.
MEMO_SEGMENTS = 1 << 18
MEMO_CHARS = 64_000_000
#: Segments encoded as one line.
LINE = 128
#: A larger group is linked by its distinct ids and their numbers instead of token by token.
GROUP_LINKS = 256

_CUT = re.compile(r"(?<=\S) (?=\S)")
_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def _byte_level() -> dict[str, int]:
    """The byte that a character of a byte-level vocabulary stands for: printable Latin-1 characters stand for
    themselves, the other bytes in ascending order are written as the characters from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = sorted(set(range(256)) - set(printable))
    return {chr(c): c for c in printable} | {chr(0x100 + k): c for k, c in enumerate(others)}


def _piece_bytes(piece: str) -> bytes:
    if re.fullmatch(r"<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in order, and their number in each list."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


def _joined(side: tuple[np.ndarray, np.ndarray], spelt: list[bytes], wholes: list[bytes]) -> np.ndarray:
    """Whether the bytes of the ids of each segment are its whole."""
    ids, ends = side[0].tolist(), np.cumsum(side[1]).tolist()
    return np.array([b"".join(map(spelt.__getitem__, ids[at:end])) == whole for at, end, whole in zip([0, *ends], ends, wholes)], bool)


def _encodable(texts: list[str]) -> bool:
    """Whether all are Unicode without lone surrogates."""
    try:
        "".join(texts).encode()
    except UnicodeEncodeError:
        return False
    return True


class Tokenizers:
    """Both encoders, the bytes of their ids, and whether texts may be cut into segments."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        units = _byte_level()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, at in vocabulary.items():
            self.a_bytes[at] = bytes(units[c] for c in token) if all(c in units for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [_piece_bytes(p) for p in pieces]
        #: Ids as text after each of the signs of a digest.
        ids = range(max(len(self.a_bytes), len(self.b_bytes)))
        self.names = np.array([[f"{sign}{k}" for k in ids] for sign in ";|,"], object)
        self.a_sizes = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(t) for t in self.b_bytes], np.int64)
        # Cuts are safe if A splits its input at spaces by the byte-level rule and no piece of B goes on after a word.
        with open(a_path, encoding="utf-8") as file:
            parts = json.load(file)
        splits = parts["normalizer"] is None and parts["pre_tokenizer"] == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": parts["pre_tokenizer"].get("trim_offsets"), "use_regex": True,
        }
        self.cuts = splits and not any(re.search("[^▁]▁", p) for p in pieces)

    def segments(self, text: str) -> list[str]:
        """The parts of a text without the space that each begins with."""
        return _CUT.split(text) if self.cuts else [text]

    def encoded(self, segments: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """(all ids, number of ids per segment) of space + segment under A, and of the segment under B, which adds the
        space."""
        a = self.a.encode_batch([f" {s}" for s in segments], add_special_tokens=False)
        return _flat([e.ids for e in a]), _flat(self.b.encode(segments, num_threads=1))

    def encoded_in_lines(self, segments: list[str], wholes: list[bytes]):
        """The same for segments that neither begin nor end with white space, a line of them at a time: cut again at
        the segments, the ids of a line are those of each. None if bytes are not given back as they are."""
        lines = [" ".join(segments[at : at + LINE]) for at in range(0, len(segments), LINE)]
        whole, ends = b"".join(wholes), np.cumsum(np.fromiter(map(len, wholes), np.int64, len(wholes)))
        sides = []
        for (ids, _), spelt, sizes in zip(self.encoded(lines), (self.a_bytes, self.b_bytes), (self.a_sizes, self.b_sizes)):
            if b"".join(map(spelt.__getitem__, ids.tolist())) != whole:
                return None
            reach = np.cumsum(sizes[ids])
            last = np.searchsorted(reach, ends)
            if not np.array_equal(reach[last], ends):
                return None
            sides.append((ids, np.diff(last + 1, prepend=0)))
        return sides


def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """Loaded once in each worker."""
    return once_per_worker(("alignment", a_path, b_path), lambda: Tokenizers(a_path, b_path))


def coalesced(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group number of each A token and of each B token; both sides tile the same bytes in order."""
    ends = np.concatenate([np.cumsum(a_sizes), np.cumsum(b_sizes)])
    starts = ends - np.concatenate([a_sizes, b_sizes])
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    breaks = starts[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.concatenate([[0], np.cumsum(breaks)]) if len(order) else 0
    return group[: len(a_sizes)], group[len(a_sizes) :]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at `starts`, one range after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - np.repeat(before - starts, sizes)


def expanded(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair code, number of links) within every group: A tokens times B tokens.

    Large groups give a row per pair of distinct ids.
    """
    n = int(a_group[-1]) + 1 if len(a_group) else 0
    n_a, n_b = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
    b_first = np.cumsum(n_b) - n_b
    plain = (n_a * n_b <= GROUP_LINKS)[a_group]
    times = n_b[a_group[plain]]
    partners = b[ranges(b_first[a_group[plain]], times)]
    groups = [np.repeat(a_group[plain], times)]
    codes = [np.repeat(a[plain], times) << 32 | partners]
    counts = [np.ones(len(partners), np.int64)]
    a_first = np.cumsum(n_a) - n_a
    for g in np.flatnonzero(n_a * n_b > GROUP_LINKS).tolist():
        own, own_n = np.unique(a[a_first[g] : a_first[g] + n_a[g]], return_counts=True)
        other, other_n = np.unique(b[b_first[g] : b_first[g] + n_b[g]], return_counts=True)
        codes.append((own[:, None] << 32 | other[None, :]).ravel())
        counts.append((own_n[:, None] * other_n[None, :]).ravel())
        groups.append(np.full(len(codes[-1]), g))
    return np.concatenate(groups), np.concatenate(codes), np.concatenate(counts)


def written(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, names: np.ndarray) -> list[str]:
    """All tokens in order of group and side, each with the sign before it: `;` opens a group, `|` its B tokens and
    `,` goes on. `names` holds the ids with each of the three signs."""
    group, side = np.concatenate([a_group, b_group]), np.repeat([0, 1], [len(a), len(b)])
    order = np.lexsort((side, group))
    group, side, ids = group[order], side[order], np.concatenate([a, b])[order]
    sign = np.full(len(ids), 2)
    sign[1:][side[1:] != side[:-1]] = 1
    sign[np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))[: len(ids)]] = 0
    return names[sign, ids].tolist()


class Segments:
    """What a worker knows of the segments it has met: counts, digest and id pairs with their numbers."""

    def __init__(self, coders: Tokenizers):
        self.coders = coders
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.digests: list[str] = []
        self.chars = 0
        self.numbers = np.empty((0, len(_COUNTS)), np.int64)
        self.good = np.empty(0, bool)
        self.sizes = np.empty(0, np.int64)
        self.firsts = np.empty(0, np.int64)
        self.codes = np.empty(0, np.int64)
        self.times = np.empty(0, np.int64)

    def find(self, segments: list[str]) -> np.ndarray:
        """Places of the segments; new ones are encoded and coalesced together."""
        if len(self.places) > MEMO_SEGMENTS or self.chars > MEMO_CHARS:
            self.clear()
        new = [s for s in dict.fromkeys(segments) if s not in self.places]
        if new:
            self._add(new)
        return np.fromiter(map(self.places.__getitem__, segments), np.int64, len(segments))

    def _add(self, new: list[str]) -> None:
        c = self.coders
        plain = [s for s in new if s and not (s[0].isspace() or s[-1].isspace())] if c.cuts else []
        sides = c.encoded_in_lines(plain, [f" {s}".encode() for s in plain]) if plain and _encodable(plain) else None
        if sides:
            self._keep(plain, np.ones(len(plain), bool), *sides)
            known = set(plain)
            new = [s for s in new if s not in known]
        if new:
            wholes = [f" {s}".encode(errors="replace") for s in new]
            a, b = c.encoded(new)
            good = _joined(a, c.a_bytes, wholes) & _joined(b, c.b_bytes, wholes)
            a, b = ((ids[np.repeat(good, n)], np.where(good, n, 0)) for ids, n in (a, b))
            self._keep(new, good, a, b)

    def _keep(self, new: list[str], good: np.ndarray, a_side: tuple[np.ndarray, np.ndarray], b_side: tuple[np.ndarray, np.ndarray]) -> None:
        c, (a, a_n), (b, b_n) = self.coders, a_side, b_side
        a_group, b_group = coalesced(c.a_sizes[a], c.b_sizes[b])
        group, codes, times = expanded(a, b, a_group, b_group)

        # Groups never span segments: both sides end at the end of each.
        numbers = np.zeros((len(new), len(_COUNTS)), np.int64)
        n_groups = int(a_group[-1]) + 1 if len(a_group) else 0
        owner = np.zeros(n_groups, np.int64)
        owner[a_group] = np.repeat(np.arange(len(new)), a_n)
        numbers[:, 0], numbers[:, 1] = a_n, b_n
        numbers[:, 2] = np.bincount(owner, minlength=len(new))
        np.add.at(numbers[:, 3], owner[group], times)
        segment = owner[group]
        order = np.lexsort((codes, segment))
        segment, codes, times = segment[order], codes[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], (segment[1:] != segment[:-1]) | (codes[1:] != codes[:-1])])) if len(codes) else np.empty(0, np.int64)
        times = np.add.reduceat(times, first) if len(first) else times
        sizes = np.bincount(segment[first], minlength=len(new))

        line, ends = written(a, b, a_group, b_group, c.names), np.cumsum(a_n + b_n).tolist()
        digests = ["".join(line[at:end]) for at, end in zip([0, *ends], ends)]
        base = len(self.digests)
        self.places.update(zip(new, range(base, base + len(new))))
        self.digests += digests
        self.chars += sum(map(len, digests)) + sum(map(len, new))
        self.firsts = np.concatenate([self.firsts, len(self.codes) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.codes, self.times = np.concatenate([self.codes, codes[first]]), np.concatenate([self.times, times])
        self.numbers, self.good = np.concatenate([self.numbers, numbers]), np.concatenate([self.good, good])


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(first) else values


class Aligned:
    """Documents of a batch: numbers, digests, and the id pairs of each with their numbers of links."""

    def __init__(self, memo: Segments, texts: list[str | None]):
        cut = [memo.coders.segments(t) if t else [] for t in texts]
        sizes = np.array([len(c) for c in cut], np.int64)
        places = memo.find([s for c in cut for s in c])
        doc = np.repeat(np.arange(len(texts)), sizes)
        self.good = (sizes > 0) & (np.bincount(doc, ~memo.good[places], minlength=len(texts)) == 0)
        ends = np.cumsum(sizes).tolist()
        self.digests = []
        for k, (end, size, good) in enumerate(zip(ends, sizes.tolist(), self.good.tolist())):
            line = "".join(map(memo.digests.__getitem__, places[end - size : end].tolist()))[1:]
            self.digests.append(hashlib.sha256(line.encode()).hexdigest() if good else "")
        used = self.good[doc]
        doc, places = doc[used], places[used]
        self.numbers = np.stack([
            np.bincount(doc, memo.numbers[places, k], minlength=len(texts)).astype(np.int64) for k in range(len(_COUNTS))
        ], axis=1)
        own, n = _summed(doc * (1 << 32) + places, np.ones(len(doc), np.int64))
        doc, places = own >> 32, own & 0xFFFFFFFF
        spread = memo.sizes[places]
        at = ranges(memo.firsts[places], spread)
        doc, codes, times = np.repeat(doc, spread), memo.codes[at], memo.times[at] * np.repeat(n, spread)
        order = np.lexsort((codes, doc))
        doc, codes, times = doc[order], codes[order], times[order]
        if len(doc):
            first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (codes[1:] != codes[:-1])]))
            doc, codes, times = doc[first], codes[first], np.add.reduceat(times, first)
        self.doc, self.codes, self.times = doc, codes, times


def _narrow(values: np.ndarray) -> bytes:
    """A byte for the width, and the numbers in that width."""
    kind = np.min_scalar_type(int(values.max())) if len(values) else np.dtype(np.uint8)
    return bytes([kind.itemsize]) + values.astype(kind).tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def chunk_rows(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE, chars: int = CHUNK_CHARS) -> DataFrame:
    """A row per document: chunk, doc_id, numbers, digest, places of its pairs in the chunk's dictionary and their
    numbers of links; and a row per chunk with the dictionary (`codes`, `holders`)."""
    own = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"chunk bigint, doc_id {own}, {', '.join(f'{c} bigint' for c in _COUNTS)}, groups_sha256 string, places binary, "
        "times binary, codes binary, holders binary"
    )

    def closed(chunk: int, ids: list[pa.Array], done: list[Aligned]) -> pa.RecordBatch:
        sizes = [len(x.good) for x in done]
        doc = np.concatenate([x.doc + at for x, at in zip(done, np.cumsum([0, *sizes]).tolist())])
        # A document holds a pair once, so a pair's number of rows is its number of documents.
        codes, places, holders = np.unique(np.concatenate([x.codes for x in done]), return_inverse=True, return_counts=True)
        ends = np.cumsum(np.bincount(doc, minlength=sum(sizes)))[:-1]
        times = np.concatenate([x.times for x in done])
        numbers = np.concatenate([x.numbers for x in done])
        blank = [None] * len(numbers)
        doc_ids = pa.concat_arrays(ids)
        return pa.RecordBatch.from_arrays([
            pa.array([chunk] * (len(numbers) + 1), pa.int64()),
            pa.concat_arrays([doc_ids, pa.nulls(1, doc_ids.type)]),
            *[pa.array([*numbers[:, k].tolist(), None], pa.int64()) for k in range(len(_COUNTS))],
            pa.array([d for x in done for d in x.digests] + [None], pa.string()),
            pa.array([*map(_narrow, np.split(places, ends)), None], pa.binary()),
            pa.array([*map(_narrow, np.split(times, ends)), None], pa.binary()),
            pa.array([*blank, codes.tobytes()], pa.binary()),
            pa.array([*blank, holders.astype(np.int64).tobytes()], pa.binary()),
        ], names=["chunk", "doc_id", *_COUNTS, "groups_sha256", "places", "times", "codes", "holders"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Segments(tokenizers(a_path, b_path))
        chunk, ids, done, size, n = TaskContext.get().partitionId() << 32, [], [], 0, 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if not texts:
                continue
            ids.append(batch.column("doc_id"))
            done.append(Aligned(memo, texts))
            size, n = size + sum(len(t) for t in texts if t), n + len(texts)
            if size >= chars or n >= CHUNK_DOCS:
                yield closed(chunk, ids, done)
                chunk, ids, done, size, n = chunk + 1, [], [], 0, 0
        if done:
            yield closed(chunk, ids, done)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def dictionary_pairs(rows: DataFrame) -> DataFrame:
    """(chunk, a, b, n) of the dictionaries in `chunk_rows`; n is the number of the chunk's documents that hold the pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, codes, holders in zip(*(c.to_pylist() for c in batch.columns)):
                pair = np.frombuffer(codes, np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(pair), chunk)), pa.array((pair >> 32).astype(np.int32)),
                    pa.array((pair & 0xFFFFFFFF).astype(np.int32)), pa.array(np.frombuffer(holders, np.int64)),
                ], names=["chunk", "a", "b", "n"])

    dictionaries = rows.filter(F.col("codes").isNotNull()).select("chunk", "codes", "holders")
    return dictionaries.mapInArrow(run, "chunk bigint, a int, b int, n bigint")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, count, best): in how many documents an id pair is linked, and whether no pair of its A id is in more.

    The table holds at most the product of the two vocabularies, whatever the corpus.
    """
    counts = checkpointed(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")), "pair-counts")
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    return counts.join(highest, "a").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))


def aligned(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE, chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of `docs`."""
    rows = checkpointed(chunk_rows(docs, a_path, b_path, chars), "aligned")
    pairs = dictionary_pairs(rows)
    found = pairs.join(pair_counts(pairs), ["a", "b"]).select("chunk", "a", "b", "count", "best")
    columns = ["chunk", "doc_id", *_COUNTS, "groups_sha256", "places", "times"]
    own = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {own}, {', '.join(f'{c} bigint' for c in _COUNTS)}, n_best bigint, count_sum bigint, groups_sha256 string"

    def rate(left: pa.Table, right: pa.Table) -> pa.Table:
        # Pairs in order of their codes stand at their places in the dictionary.
        right = right.sort_by([("a", "ascending"), ("b", "ascending")])
        count, best = right.column("count").to_numpy(), right.column("best").to_numpy().astype(np.int64)
        places, times = ([_wide(x) for x in left.column(c).to_pylist()] for c in ("places", "times"))
        ends = np.cumsum([0, *map(len, places)])
        at, n = np.concatenate([*places, np.empty(0, np.int64)]), np.concatenate([*times, np.empty(0, np.int64)])
        sums = []
        for values in (best[at] * n, count[at] * n):
            before = np.concatenate([[0], np.cumsum(values)])
            sums.append(pa.array(before[ends[1:]] - before[ends[:-1]], pa.int64()))
        names = ["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"]
        return pa.table([left.column("doc_id"), *[left.column(c) for c in _COUNTS], *sums, left.column("groups_sha256")], names=names)

    documents = rows.filter(F.col("codes").isNull()).select(*columns)
    return documents.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(rate, schema)
