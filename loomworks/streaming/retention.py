"""Counters of ended jobs that fall again when the jobs expire: a job's state makes changes, windows add them up.

Two stateful operators in a row. The first keeps each job's status and the time at which retention forgets it, and
tells every change of a count: one more when a job ends, one less when it is queued again or expires. The second adds
the changes up in windows of event time, partly in each task first, so that no task sees all changes of a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .lifecycle import ENDED, step

STATE = T.StructType([T.StructField("status", T.StringType()), T.StructField("due_ms", T.LongType())])
CHANGES = T.StructType([T.StructField("status", T.StringType()), T.StructField("change", T.LongType()), T.StructField("at", T.TimestampType())])


def follow(held: tuple[str, int], at: int, event: str, keep_ms: int) -> tuple[tuple[str, int], list[tuple[str, int, int]]]:
    """A job (status, due; due -1: it has not ended) after an event, and the changes (status, change, at) of the counts.

    An ended job that is due by then has gone first, and the event finds none. Illegal transitions change nothing.
    """
    status, due = held
    rows = []
    if 0 <= due <= at:
        rows.append((status, -1, due))
        status, due = "", -1
    after, _, _ = step(status, 0, 0, event)
    if after != status:
        rows += [(status, -1, at)] if status in ENDED else []
        rows += [(after, 1, at)] if after in ENDED else []
        due = at + keep_ms if after in ENDED else -1
    return (after, due), rows


def _frame(rows: list[tuple[str, int, int]]) -> pd.DataFrame:
    return pd.DataFrame({"status": [r[0] for r in rows], "change": [r[1] for r in rows], "at": pd.to_datetime([r[2] for r in rows], unit="ms")})


class Retained(StatefulProcessor):
    """``follow`` over the events (job_id, at_ms, event_id, event) of each job."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("job", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = before = tuple(self.state.get()) if self.state.exists() else ("", -1)
        out = []
        for r in pd.concat(list(rows)).sort_values(["at_ms", "event_id"]).itertuples():
            held, made = follow(held, r.at_ms, r.event, self.keep_ms)
            out += made
        if before[1] >= 0 and before[1] != held[1]:
            self.handle.deleteTimer(before[1])
        if held[1] >= 0 and held[1] != before[1]:
            self.handle.registerTimer(held[1])
        self.state.update(held)
        if out:
            yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, due = self.state.get() if self.state.exists() else ("", -1)
        if due == expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
            yield _frame([(status, -1, due)])

    def close(self) -> None:
        pass


def changes(events: DataFrame, keep_seconds: float, late: str = "10 minutes", length: str = "1 day") -> DataFrame:
    """(start, status, change): how the number of retained jobs of an ended status changes in each window of a stream.

    ``events`` has (job_id, event_id, ts, event). A window is told once the watermark has passed it. The session's time
    zone must be UTC, and its state store RocksDB (``retries.use_timers``).
    """
    at = events.filter(F.col("job_id").isNotNull()).withWatermark("ts", late).withColumn("at_ms", F.unix_millis("ts"))
    told = at.groupBy("job_id").transformWithStateInPandas(Retained(int(keep_seconds * 1000)), CHANGES, "Append", "EventTime", eventTimeColumnName="at")
    return told.groupBy(F.window("at", length).alias("w"), "status").agg(F.sum("change").alias("change")).select(F.col("w.start").alias("start"), "status", "change")


def counters(told: DataFrame) -> DataFrame:
    """(start, status, n): the counts at the end of each window of ``changes`` read so far, where they changed."""
    upto = F.sum("change").over(Window.partitionBy("status").orderBy("start"))
    return told.groupBy("start", "status").agg(F.sum("change").alias("change")).select("start", "status", upto.alias("n"))
