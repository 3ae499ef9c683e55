import re
import shutil
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chatrisk import views
from chatrisk.functions.catalog import DEFAULT
from chatrisk.operators import contacts, messages
from chatrisk.sources import corpus, sinks
from chatrisk.streaming import alerts as streams


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """Each partition has a state of its own to open and commit in every micro-batch."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def feed_files(spark, sf_dir, tmp_path_factory):
    """The contact messages in time order, several files."""
    folder = tmp_path_factory.mktemp("feed")
    rows = views.contact_messages(views.read_table(spark, sf_dir, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withColumn("reset", F.lit(False))
    for i, (low, high) in enumerate([(0, 300), (300, 301), (301, 1000)]):
        rows.filter((F.col("msg_id") >= low) & (F.col("msg_id") < high)).coalesce(1).write.parquet(str(folder / f"part{i}"))
    return folder, rows


def test_stream_over_restarts_equals_batch(spark, feed_files, tmp_path):
    folder, rows = feed_files
    streams.prepare_session(spark)
    incoming = tmp_path / "in"
    incoming.mkdir()
    for i in range(3):  # a stopped stream goes on from its checkpoint with the window kept
        for file in (folder / f"part{i}").glob("*.parquet"):
            shutil.copy(file, incoming / f"{i}-{file.name}")
        stream = streams.alert_stream(corpus.read_feed(spark, str(incoming), files_per_batch=1)).drop("matches")
        sinks.write_alerts(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    raised = contacts.alerts(contacts.with_window(messages.annotate_contacts(rows), ["contact_id"], ["ts", "msg_id"]))
    columns = ["contact_id", "msg_id", "level", "reason", "score", "window_len", "risky_count"]
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.select(columns).exceptAll(raised.select(columns)).count() == 0
    assert found.count() == raised.count() > 0


def copied(folder, parts, incoming, name):
    for file in (folder / f"part{parts}").glob("*.parquet"):
        shutil.copy(file, incoming / f"{name}-{file.name}")
        time.sleep(0.05)  # files are taken in the order of their times


def test_redelivered_files_count_once(spark, feed_files, tmp_path):
    folder, rows = feed_files
    streams.prepare_session(spark)
    incoming = tmp_path / "in"
    incoming.mkdir()
    for i, part in enumerate([0, 1, 0, 2, 1]):  # files come again, in the same run and after a restart
        copied(folder, part, incoming, i)
        if i in (2, 4):
            scored = streams.stream_windows(corpus.read_feed(spark, str(incoming), files_per_batch=1, redelivered=True))
            sinks.write_alerts_and_stats(scored, *(str(tmp_path / p) for p in ("alerts", "stats", "state"))).awaitTermination()
    batch = contacts.with_window(messages.annotate_contacts(rows), ["contact_id"], ["ts", "msg_id"])
    stats = spark.read.parquet(str(tmp_path / "stats"))
    wanted = contacts.window_stats(batch, ["contact_id", "ts", "msg_id"])
    assert stats.count() == wanted.count() and stats.select(wanted.columns).exceptAll(wanted).count() == 0
    raised = contacts.alerts(batch).select("contact_id", "msg_id", "level", "reason", "score")
    found = spark.read.parquet(str(tmp_path / "alerts")).select(raised.columns)
    assert found.count() == raised.count() > 0 and found.exceptAll(raised).count() == 0


def test_late_copies_are_dropped_within_a_bound(spark, feed_files, tmp_path):
    folder, rows = feed_files
    incoming = tmp_path / "in"
    incoming.mkdir()
    for i in range(2):
        copied(folder, 1, incoming, i)
    feed = corpus.read_feed(spark, str(incoming), redelivered=True, within="10 days").select("contact_id", "msg_id")
    sinks.write_alerts(feed, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.filter("msg_id = 300").count() == 1


def test_a_repeated_batch_is_written_once(spark, feed_files, tmp_path):
    """A batch that was written but not committed runs again and replaces its own rows."""
    folder, _ = feed_files
    streams.prepare_session(spark)
    incoming = tmp_path / "in"
    incoming.mkdir()
    paths = [str(tmp_path / p) for p in ("alerts", "stats", "state")]
    for i in range(2):
        copied(folder, i, incoming, i)
        sinks.write_alerts_and_stats(streams.stream_windows(corpus.read_feed(spark, str(incoming))), *paths).awaitTermination()
    before = spark.read.parquet(paths[1]).count()
    last = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    sinks.write_alerts_and_stats(streams.stream_windows(corpus.read_feed(spark, str(incoming))), *paths).awaitTermination()
    again = spark.read.parquet(paths[1])
    assert again.count() == before == again.select("msg_id").distinct().count()


@pytest.mark.parametrize("expires, length", [(None, 2), (500, 1)])
def test_a_silent_contact_is_forgotten(spark, tmp_path, expires, length):
    streams.prepare_session(spark)
    incoming = tmp_path / "in"
    row = "(1L, timestamp'2024-01-01 00:00:0{0}', {0}L, 'external', 'hi', 0.1D, false)"
    names = [f.split()[0] for f in corpus.FEED_SCHEMA.split(", ")]
    for i in range(2):
        spark.sql(f"SELECT * FROM VALUES {row.format(i)} AS t({', '.join(names)})").write.mode("append").parquet(str(incoming))
        scored = streams.stream_windows(corpus.read_feed(spark, str(incoming)), expires_ms=expires).select("msg_id", "window_len")
        sinks.write_alerts(scored, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        time.sleep(1)
    assert {r.msg_id: r.window_len for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {0: 1, 1: length}


def test_ids_of_other_types(spark, feed_files, tmp_path):
    """Contacts and messages named by text give the windows that numbers give."""
    _, rows = feed_files
    streams.prepare_session(spark)
    named = rows.withColumns({"contact_id": F.concat(F.lit("c-"), "contact_id"), "msg_id": F.format_string("%08d", "msg_id")})
    named.select([f.split()[0] for f in corpus.FEED_SCHEMA.split(", ")]).coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = corpus.FEED_SCHEMA.replace("contact_id BIGINT", "contact_id STRING").replace("msg_id BIGINT", "msg_id STRING")
    scored = streams.stream_windows(corpus.read_feed(spark, str(tmp_path / "in"), schema=schema)).select("contact_id", "msg_id", "score")
    sinks.write_alerts(scored, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    batch = contacts.with_window(messages.annotate_contacts(named), ["contact_id"], ["ts", "msg_id"]).select("contact_id", "msg_id", "score")
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.count() == batch.count() and found.exceptAll(batch).count() == 0


class KeptWindows:
    """A map state in memory."""

    def __init__(self):
        self.kept = {}

    def getMapState(self, name, key, value, ttlDurationMs=None):
        return self

    def getValue(self, key):
        return self.kept.get(key)

    def updateValue(self, key, value):
        self.kept[key] = value


@pytest.mark.parametrize("size", [1, 2, 5, 30])
def test_many_contacts_are_worked_on_in_one_call(monkeypatch, size):
    """Windows of a bucket's contacts, cut into pieces at any place, over two micro-batches with resets."""
    monkeypatch.setattr(streams, "EMIT_ROWS", 7)
    rng, n = np.random.default_rng(size), 160
    rows = pd.DataFrame({
        "contact_key": [f"={c}" for c in rng.choice(12, n, p=[0.45, *[0.05] * 11])], "ts": np.arange(n) // 3, "msg_id": np.arange(n),
        "sender": rng.choice(["external", "child"], n, p=[0.8, 0.2]), "max_severity": rng.integers(0, 4, n),
        "ml_prob": np.where(rng.random(n) < 0.1, np.nan, rng.random(n)), "cat_mask": rng.integers(0, 1 << len(DEFAULT.categories), n),
        "reset": rng.random(n) < 0.1})
    params = contacts.WindowParams(size=size)
    operator, found = streams.LastMessages(params), []
    operator.init(KeptWindows())
    for batch in (rows[:90], rows[90:]):
        found += operator.handleInputRows((0,), iter([batch.sample(frac=1, random_state=1)]), None)
    found = pd.concat(found).set_index("msg_id")
    packed, windows = contacts.PackedCounts(DEFAULT, size), {}
    assert len(found) == n
    for row in rows.itertuples():
        window = [] if row.reset else windows.get(row.contact_key, [])
        windows[row.contact_key] = window = [*window, row][-size:]
        external = [m for m in window if m.sender == "external"]
        at = lambda holds: [k for k, m in enumerate(external, 1) if holds(m)]
        runs = re.findall("E{3,}", "".join("E" if m.sender == "external" else "c" for m in window))
        own = found.loc[row.msg_id]
        assert own[streams.COUNTS].tolist() == [
            len(window), len(external), len(at(lambda m: m.ml_prob >= params.theta_high)),
            len(at(lambda m: m.ml_prob >= params.theta_medium or m.max_severity >= 2)), len(runs)]
        trust, solicit = (DEFAULT.mask(names) for names in (DEFAULT.trust, DEFAULT.solicit))
        assert own["_trust"] == min(at(lambda m: m.cat_mask & trust), default=size + 1)
        assert own["_solicit"] == max(at(lambda m: m.cat_mask & solicit), default=0)
        for k in (1, 2, 3):
            assert own[f"_first{k}"] == min(at(lambda m: m.max_severity >= k), default=size + 1)
            assert own[f"_last{k}"] == max(at(lambda m: m.max_severity >= k), default=0)
        for k, category in enumerate(DEFAULT.categories):
            word, slot = divmod(k, packed.per_word)
            count = len(at(lambda m: m.cat_mask >> k & 1))
            assert own[f"_packed{word}"] >> slot * packed.bits & (1 << packed.bits) - 1 == count
            assert own["window_mask"] >> k & 1 == (count > 0)
