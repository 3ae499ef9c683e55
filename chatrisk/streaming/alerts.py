"""Alerts on a message stream.

The stateful operator only remembers the last messages of each contact and gives every message the
figures of its window: counts, masks, and ordinals of messages. Contacts are dealt to buckets, whose
messages are worked on together. Rules are matched before it and the score is computed after it by
the same expressions as in batch, so that both agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chatrisk import config
from chatrisk.functions import scoring
from chatrisk.functions.catalog import DEFAULT, MASK_BITS, Catalog
from chatrisk.operators.contacts import EXTERNAL, PackedCounts, WindowParams, alerts, window_stats, with_score
from chatrisk.operators.messages import annotate_contacts

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MATCHES = "ARRAY<STRUCT<rule_id: INT, category: STRING, severity: INT, text: STRING>>"


EMIT_ROWS = 5_000  # rows worked on together and handed back
#: Groups of contacts by hash. Kept windows are found by it: changing it means a new checkpoint.
BUCKETS = 1024


def state_schema(catalog: Catalog) -> str:
    """The kept messages of a contact, an element each: external or not, severity, probability, and category mask words."""
    return ", ".join(["ext ARRAY<BOOLEAN>, sev ARRAY<BIGINT>, prob ARRAY<DOUBLE>",
                      *(f"{c} ARRAY<BIGINT>" for c in scoring.word_names("mask", catalog))])


COUNTS = ["window_len", "n_external", "high_risk_count", "risky_count", "n_runs"]
PLACES = ["_trust", "_solicit", *(f"_{end}{k}" for end in ("first", "last") for k in scoring.SEVERITIES)]


def window_schema(params: WindowParams, catalog: Catalog, ids: dict[str, str]) -> str:
    """A message and the figures of its window; `ids` are the types of its ids."""
    words = [*scoring.word_names("cat_mask", catalog), *scoring.word_names("window_mask", catalog), *PackedCounts(catalog, params.size).names]
    return (f"contact_id {ids['contact_id']}, ts TIMESTAMP, msg_id {ids['msg_id']}, sender STRING, text STRING, ml_prob DOUBLE, "
            f"matches_json STRING, max_severity INT, {', '.join(f'{c} BIGINT' for c in words)}, {', '.join(f'{c} INT' for c in COUNTS + PLACES)}")


class Frames:
    """The last `size` messages of each message in a row of them, none from before its latest reset.

    A frame goes from `low` to the message itself; all figures of frames are differences of running sums.
    """

    def __init__(self, external: np.ndarray, resets: np.ndarray, size: int):
        self.n, self.at = len(external), np.arange(len(external))
        self.low = np.maximum(np.maximum.accumulate(np.where(resets, self.at, 0)), self.at - (size - 1))
        self.size, self.external, self.ordinals = size, external, self._sums(external)

    @staticmethod
    def _sums(values: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, axis=0, dtype=np.int64)])

    def lengths(self) -> np.ndarray:
        return self.at - self.low + 1

    def total(self, values: np.ndarray) -> np.ndarray:
        sums = self._sums(values)
        return sums[1:] - sums[self.low]

    def first(self, holds: np.ndarray) -> np.ndarray:
        """Number among the frame's external messages of the first one that holds; beyond them all if none does."""
        following = np.minimum.accumulate(np.where(holds, self.at, self.n)[::-1])[::-1][self.low]
        place = self.ordinals[np.minimum(following, self.n - 1) + 1] - self.ordinals[self.low]
        return np.where(following <= self.at, place, self.size + 1)

    def last(self, holds: np.ndarray) -> np.ndarray:
        """The same of the last one that holds; 0 if none does."""
        latest = np.maximum.accumulate(np.where(holds, self.at, -1))
        return np.where(latest >= self.low, self.ordinals[latest + 1] - self.ordinals[self.low], 0)

    def runs(self, length: int) -> np.ndarray:
        """Unbroken runs of at least `length` external messages inside the frame."""
        full = np.zeros(self.n, bool)
        full[length - 1:] = self.ordinals[length:] - self.ordinals[:max(self.n + 1 - length, 0)] == length
        begun = full.copy()  # reaches the length at this message, counted from a start behind another message
        begun[length:] &= ~self.external[:max(self.n - length, 0)]
        sums = self._sums(begun)
        inner = sums[1:] - sums[np.minimum(self.low + length, self.at + 1)]
        cut = self.low + length - 1  # where a run from the frame's first message reaches it
        return inner + ((cut <= self.at) & full[np.minimum(cut, self.n - 1)])


class LastMessages(StatefulProcessor):
    """Keeps the last `size` - 1 messages of each contact of a bucket; emits each message with its window's figures.

    A micro-batch is applied in (ts, msg_id) order; a reset row clears the window before itself. A contact's window is
    forgotten when no message of it came for `expires_ms`. The rows of one bucket in one micro-batch are ordered
    together, which the source's per-trigger limit bounds; the figures are found and handed back in pieces.
    """

    def __init__(self, params: WindowParams, catalog: Catalog = DEFAULT, expires_ms: int | None = None):
        self.params, self.size, self.expires_ms = params, params.size, expires_ms
        self.schema = state_schema(catalog)
        self.masks = scoring.word_names("cat_mask", catalog)
        self.window_masks = scoring.word_names("window_mask", catalog)
        packed = PackedCounts(catalog, params.size)
        self.packed = packed.names
        # A message's category bits (64 a word) times this matrix are its words of packed counts.
        self.fields = np.zeros((64 * len(self.masks), packed.words), np.int64)
        for k in range(len(catalog.categories)):
            word, slot = divmod(k, packed.per_word)
            self.fields[k // MASK_BITS * 64 + k % MASK_BITS, word] = 1 << slot * packed.bits
        self.groups = {"_trust": self._words(catalog.mask(catalog.trust)), "_solicit": self._words(catalog.mask(catalog.solicit))}

    def _words(self, wanted: int) -> np.ndarray:
        return np.array([wanted >> k * MASK_BITS & (1 << MASK_BITS) - 1 for k in range(len(self.masks))], np.int64)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.windows = handle.getMapState("windows", "contact STRING", self.schema, ttlDurationMs=self.expires_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        batch["number"] = pd.factorize(batch["contact_key"])[0]
        batch = batch.sort_values(["number", "ts", "msg_id"], kind="stable", ignore_index=True)
        names, resets = batch.pop("contact_key"), batch.pop("reset").fillna(False).to_numpy(bool)
        ends = np.append(np.flatnonzero(np.diff(batch.pop("number"))) + 1, len(batch))  # where the next contact begins
        kept = None  # the window of a contact that goes on from the piece before
        for start in range(0, len(batch), EMIT_ROWS):
            piece = batch[start:start + EMIT_ROWS]
            arrived = [column.to_numpy(t) for column, t in zip((
                piece["sender"] == EXTERNAL, piece["max_severity"], piece["ml_prob"], *(piece[c] for c in self.masks)), self._types())]
            end = start + len(piece)
            stops = np.append(ends[np.searchsorted(ends, start, "right"):np.searchsorted(ends, end)], end) - start
            begins = np.append(0, stops[:-1])
            contacts = [(name,) for name in names.iloc[start + begins]]
            before = [self._kept(contact) if kept is None or k > 0 else kept for k, contact in enumerate(contacts)]
            whole = [np.concatenate([part for old, begin, stop in zip(before, begins, stops) for part in (old[c], new[begin:stop])])
                     for c, new in enumerate(arrived)]
            held = np.fromiter((len(old[0]) for old in before), np.int64, len(before))
            places = np.arange(len(piece)) + np.repeat(np.cumsum(held), stops - begins)  # of the arrived ones in the whole
            clear = np.zeros(len(whole[0]), bool)
            clear[places] = resets[start:end]
            clear[places[begins] - held] = True  # nothing is seen from the contact before
            frames = Frames(whole[0], clear, self.size)
            figures = {name: values[places] for name, values in self._figures(frames, *whole[:3], np.stack(whole[3:], 1)).items()}
            yield pd.concat([piece, pd.DataFrame(figures, index=piece.index)], axis=1)
            windows = [[values[max(frames.low[last], last + 2 - self.size):last + 1] for values in whole] for last in places[stops - 1]]
            kept = windows.pop() if ends[np.searchsorted(ends, end)] != end else None  # else the contact ends here
            if self.size > 1:
                for contact, window in zip(contacts, windows):
                    self.windows.updateValue(contact, tuple(values.tolist() for values in window))

    def _kept(self, contact: tuple) -> list[np.ndarray]:
        found = self.windows.getValue(contact) if self.size > 1 else None
        return [np.array(c, t) for c, t in zip(found or [[]] * len(self._types()), self._types())]

    def _types(self) -> list[type]:
        return [bool, np.int64, np.float64, *[np.int64] * len(self.masks)]

    def _figures(self, frames: Frames, external, severity, prob, masks) -> dict[str, np.ndarray]:
        severity, masks = np.where(external, severity, 0), np.where(external[:, None], masks, 0)
        bits = np.unpackbits(masks.astype("<i8").view(np.uint8), axis=1, bitorder="little")
        counts = frames.total(bits)
        found = np.packbits(counts > 0, axis=1, bitorder="little").view("<i8")
        packed = counts @ self.fields
        risky = (prob >= self.params.theta_medium) | (severity >= 2)
        figures = dict(zip(self.window_masks, found.T)) | dict(zip(self.packed, packed.T))
        figures |= zip(COUNTS, (
            frames.lengths(), frames.total(external), frames.total(external & (prob >= self.params.theta_high)),
            frames.total(external & risky), frames.runs(config.RUN_LENGTH)))
        holds = {name: (masks & words).any(1) for name, words in self.groups.items()}
        figures |= {"_trust": frames.first(holds["_trust"]), "_solicit": frames.last(holds["_solicit"])}
        for k in scoring.SEVERITIES:
            figures |= {f"_first{k}": frames.first(severity >= k), f"_last{k}": frames.last(severity >= k)}
        return figures

    def close(self) -> None:
        pass


def prepare_session(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB state store. Expired state is left out when it is next read, so batches
    without data have nothing to do; with them a run over what is there would never end."""
    spark.conf.set(STATE_STORE, ROCKSDB)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def annotate_stream(feed: DataFrame, catalog: Catalog = DEFAULT, *, normalised: bool = False) -> DataFrame:
    """Rule hits on the stream, row by row, before any state."""
    return annotate_contacts(feed, catalog, normalised=normalised)


def stream_windows(
    feed: DataFrame, params: WindowParams = WindowParams(), catalog: Catalog = DEFAULT, *,
    normalised: bool = False, expires_ms: int | None = None,
) -> DataFrame:
    """Every message with its window figures and score. Ids of contacts and messages may be of any type that sorts.

    With `expires_ms` the window of a contact that is silent for so long, by the clock, is forgotten.
    """
    annotated = annotate_stream(feed, catalog, normalised=normalised).select(
        "contact_id", "ts", "msg_id", "sender", "text", "ml_prob",
        F.to_json("matches").alias("matches_json"), "max_severity", *scoring.word_names("cat_mask", catalog), "reset")
    named = F.coalesce(F.concat(F.lit("="), F.col("contact_id").cast("string")), F.lit(""))
    dealt = annotated.withColumn("contact_key", named).withColumn("bucket", F.pmod(F.xxhash64("contact_key"), F.lit(BUCKETS)).cast("int"))
    windows = dealt.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=LastMessages(params, catalog, expires_ms), outputStructType=window_schema(params, catalog, dict(annotated.dtypes)),
        outputMode="Append", timeMode="ProcessingTime" if expires_ms else "None")
    return score_windows(windows, params, catalog).withColumn("matches", F.from_json("matches_json", MATCHES)).drop("matches_json")


def score_windows(windows: DataFrame, params: WindowParams, catalog: Catalog) -> DataFrame:
    """The score of a window from its figures, as in batch."""
    packed = PackedCounts(catalog, params.size)
    scored = windows.withColumns({name: F.expr(sql) for name, sql in {
        "base": scoring.base_score(packed.count_of, "window_mask", catalog),
        "cooccur": scoring.pair_score("window_mask", catalog),
        "escal": scoring.escalation("n_external", lambda k: f"_first{k}", lambda k: f"_last{k}"),
        "arc": scoring.stage_arc("n_external", "_trust", "_solicit", "window_mask", catalog),
    }.items()})
    return with_score(scored.drop(*PLACES, *packed.names))


def alert_stream(feed: DataFrame, params: WindowParams = WindowParams(), catalog: Catalog = DEFAULT) -> DataFrame:
    return alerts(stream_windows(feed, params, catalog), params, catalog)


def stats_stream(feed: DataFrame, params: WindowParams = WindowParams(), catalog: Catalog = DEFAULT) -> DataFrame:
    return window_stats(stream_windows(feed, params, catalog), ["contact_id", "ts", "msg_id"], catalog)
