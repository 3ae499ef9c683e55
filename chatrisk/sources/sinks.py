"""Writers for datasets, reports, metrics and alert streams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chatrisk.functions.catalog import DEFAULT, Catalog
from chatrisk.operators.contacts import WindowParams, alerts, window_stats
from chatrisk.operators.reports import readable_text

STATS_KEYS = ["contact_id", "ts", "msg_id"]


def write_dataset(dataset: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per split."""
    dataset.write.mode("overwrite").partitionBy("split").format(fmt).save(path)


def write_json_array(dataset: DataFrame, path: str) -> None:
    """One folder per split; every file is one JSON array, a record per line."""
    def array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = "["
        for batch in batches:
            lines = []
            for value in batch.column("value").to_pylist():
                lines.append(sign + value)
                sign = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if sign == "[" else "]"])], names=["value"])

    columns = [c for c in dataset.columns if c != "split"]
    for split in ("train", "val"):
        rows = dataset.filter(F.col("split") == split).select(F.to_json(F.struct(*columns)).alias("value"))
        rows.mapInArrow(array, "value STRING").write.mode("overwrite").text(f"{path}/split={split}")


def write_analysis(report: DataFrame, path: str) -> None:
    """Ranked records without their messages, as JSON lines in rank order."""
    slim = report.drop("messages")
    slim.orderBy("idx").write.mode("overwrite").json(path)


def write_readable(report: DataFrame, path: str) -> None:
    """Ranked conversations as text, in rank order over the part files."""
    report.orderBy("idx").select(readable_text().alias("value")).write.mode("overwrite").text(path)


def write_readable_lines(lines: DataFrame, path: str) -> None:
    """The lines of `readable_lines` as text, in order over the part files; a conversation may span several."""
    lines.orderBy("idx", "part", "at").select("value").write.mode("overwrite").text(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One JSON row; the table has one row by construction."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def write_alerts(alerts: DataFrame, path: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Append alert rows to Parquet files."""
    flat = alerts.withColumn("signals", F.to_json("signals")) if "signals" in alerts.columns else alerts
    writer = flat.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def write_alerts_and_stats(
    scored: DataFrame, alerts_path: str, stats_path: str, checkpoint: str, *, params: WindowParams = WindowParams(),
    catalog: Catalog = DEFAULT, available_now: bool = True,
) -> StreamingQuery:
    """Alerts and window statistics of one stream of scored messages, from one state.

    A micro-batch's rows go to folders named by its id, which are written anew when the batch is repeated after a
    failure, so that every message counts once in either table.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist(StorageLevel.DISK_ONLY)  # the state is read and changed once for both tables
        try:
            raised = alerts(batch, params, catalog).drop("matches").withColumn("signals", F.to_json("signals"))
            for rows, path in ((raised, alerts_path), (window_stats(batch, STATS_KEYS, catalog), stats_path)):
                rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            batch.unpersist()

    writer = scored.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
