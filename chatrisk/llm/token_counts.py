"""Token counts by dynamic programming over a trie of pre-tokens.

Texts are cut into pre-tokens by a pattern. Distinct pre-tokens are sorted and dealt by range, so that neighbours
share beginnings: a task walks them as the paths of a trie and computes the unigram forward score of every prefix
once, keeping the best score and its number of tokens per depth. The number at a pre-token's end is stored, and
documents add up the numbers of their pre-tokens.

The vocabulary is a file of byte strings with ranks; a piece's score is the logarithm of its share if shares fall
with the rank as 1 / (rank + OFFSET). Every byte must be a piece, so every text has a segmentation.

Null and empty texts have no tokens. Rows are counted one by one, so ids may repeat; of equal scores the one with
fewer tokens counts. Extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from chatrisk.llm.shared_words import summed, word_counts
from chatrisk.plans.checkpoints import checkpointed

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern this vocabulary was made with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OFFSET = 10
_END = -1


def pre_tokens(text: bytes) -> list[bytes]:
    return [t.encode() for t in regex.findall(PATTERN, text.decode("utf-8", "replace"))]


def read_vocabulary(path: str) -> list[tuple[bytes, float]]:
    """(piece, log share) from lines of base64 and rank."""
    with open(path, "rb") as lines:
        ranks = [(base64.b64decode(piece), int(rank)) for piece, rank in (line.split() for line in lines if line.strip())]
    total = math.log(sum(1 / (rank + OFFSET) for _, rank in ranks))
    return [(piece, -math.log(rank + OFFSET) - total) for piece, rank in ranks]


class Forward:
    """Forward scores along the current path; `advance` reuses those of the prefix it shares with the last one."""

    def __init__(self, pieces: list[tuple[bytes, float]]):
        self.root: dict = {}
        for piece, score in pieces:
            node = self.root
            for byte in piece:
                node = node.setdefault(byte, {})
            node[_END] = score
        self.word = b""
        self.best: list[tuple[float, int]] = [(0.0, 0)]
        self.open: list[list[tuple[int, dict]]] = [[]]

    def tokens(self, word: bytes) -> int:
        """The number of tokens of the best segmentation."""
        shared = 0
        for a, b in zip(word, self.word):
            if a != b:
                break
            shared += 1
        del self.best[shared + 1 :], self.open[shared + 1 :]
        for depth in range(shared, len(word)):
            byte = word[depth]
            alive, found = [], None
            for start, node in [*self.open[depth], (depth, self.root)]:
                child = node.get(byte)
                if child is None:
                    continue
                alive.append((start, child))
                if _END in child:
                    score, count = self.best[start]
                    option = (score + child[_END], -count - 1)
                    if found is None or option > found:
                        found = option
            self.open.append(alive)
            self.best.append((found[0], -found[1]))
        self.word = word
        return self.best[len(word)][1]


def counted(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_pre_tokens, n_bytes and n_tokens of every text."""
    own = docs.select("doc_id", "text", F.lit(0).alias("kind"))
    words = checkpointed(word_counts(own, pre_tokens, lambda _id, _kind: 0, 1).select("word", "total"), "pre-tokens")
    pieces = read_vocabulary(vocabulary)
    schema = StructType([StructField("word", BinaryType()), StructField("total", LongType()), StructField("tokens", DoubleType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forward = Forward(pieces)
        for batch in batches:
            counts = [float(forward.tokens(w)) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.float64())], names=schema.names)

    parts = max(1, words.rdd.getNumPartitions())
    values = words.repartitionByRange(parts, "word").sortWithinPartitions("word").mapInArrow(walk, schema)
    sums = summed(own, checkpointed(values, "token-counts"), pre_tokens, ["tokens"])
    return sums.select(
        "doc_id", F.col("n_words").alias("n_pre_tokens"), (F.col("n_bytes") - F.col("n_words")).alias("n_bytes"),
        F.col("tokens").cast("bigint").alias("n_tokens"),
    )
