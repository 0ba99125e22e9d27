"""Streams: the same SQL over each micro-batch, CRI chunks across batches, and windowed aggregates over event time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from silt.operators.enrich import Reloading
from silt.plans.runner import run_sql
from silt.sources.text import MESSAGE_BYTES, cri_fields


def run_stream(
    source: DataFrame, sql: str, sink: Callable[[DataFrame, int], object], checkpoint: str,
    tables: Mapping[str, DataFrame | Reloading] | None = None, once: bool = False, interval: str = "1 second",
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """sql over each micro-batch of source, to sink(rows, batch id); aggregates start anew with each batch.

    The checkpoint makes delivery at least once; a sink that keys its output by the batch id makes it exactly once.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        now = {n: t.snapshot() if isinstance(t, Reloading) else t for n, t in (tables or {}).items()}
        sink(run_sql(sql, prepare(df) if prepare else df, now), batch_id)

    writer = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


CRI_OUT = "path string, time string, stream string, message string, truncated boolean"


def reassemble_stream(lines: DataFrame) -> DataFrame:
    """CRI chunks of a stream of lines (value, path) joined across micro-batches, by file and stream."""
    rows = lines.select("path", *cri_fields(F.col("value"))).where("ok")

    def join(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else ""
        out = []
        for part in parts:
            for time, flag, message in zip(part["time"], part["flag"], part["message"]):
                held += message or ""
                if flag == "F":
                    cut = len(held.encode()) > MESSAGE_BYTES
                    text = held.encode()[:MESSAGE_BYTES].decode("utf-8", "ignore") if cut else held
                    out.append((key[0], time, key[1], text, cut))
                    held = ""
        state.update((held,))
        yield pd.DataFrame(out, columns=["path", "time", "stream", "message", "truncated"])

    return rows.groupBy("path", "stream").applyInPandasWithState(
        join, CRI_OUT, "held string", "append", GroupStateTimeout.NoTimeout
    )


def windowed_counts(rows: DataFrame, time: str, window: str, late: str, *by: str, slide: str | None = None) -> DataFrame:
    """Rows by event-time window and `by`, updated as batches come, late rows within `late` counted."""
    marked = rows.withWatermark(time, late)
    return marked.groupBy(F.window(time, window, slide), *by).agg(F.count(F.lit(1)).alias("n"))


def sessions(rows: DataFrame, time: str, gap: str, late: str, *by: str) -> DataFrame:
    """Rows by session: runs of event times of one key with less than `gap` between them."""
    return rows.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count(F.lit(1)).alias("n"))
