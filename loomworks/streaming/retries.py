"""Timed retries: failed jobs are queued again after the delay of their error, up to a number of attempts.

One state row a job and one timer a job that waits. All is in event time: a retry is due its delay after the failure,
and events of the job at or after that time find it queued, whether they come in the same micro-batch or years later;
a job that no event reaches is queued by its timer once the watermark has passed. So how a log is cut into
micro-batches changes no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE = T.StructType([T.StructField("status", T.StringType()), T.StructField("attempts", T.IntegerType()), T.StructField("due_ms", T.LongType())])
OUT = T.StructType([T.StructField("job_id", T.LongType()), T.StructField("at_ms", T.LongType()), T.StructField("event", T.StringType()), T.StructField("attempt", T.IntegerType()), T.StructField("delay_ms", T.LongType())])
PLACE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def follow(held: tuple[str, int, int], at: int, event: str, retryable: bool, delay: int, most: int) -> tuple[tuple[str, int, int], list[tuple[int, str, int, int]]]:
    """A job (status, attempts, due; due -1: no retry waits) after an event, and the rows (at, event, attempt, delay) it makes.

    A retry that is due by then comes first. A failure that may be tried again queues the job and sets the time; one
    that may not, or no more, fails it. Any other event is the job's new status; a waiting retry of a job that is not
    queued any more is dropped.
    """
    status, attempts, due = held
    rows = []
    if 0 <= due <= at:
        rows.append((due, "requeued", attempts, 0))
        due = -1
    if event == "failed":
        if retryable and attempts < most:
            attempts, status, due = attempts + 1, "queued", at + delay
            rows.append((at, "retry:created", attempts, delay))
        else:
            rows.append((at, "retry:max-attempts" if retryable else "job:failed", attempts, 0))
            status, due = "failed", -1
    else:
        status, due = event, due if event == "queued" else -1
    return (status, attempts, due), rows


def _frame(job: int, rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(job, *r) for r in rows], columns=OUT.names)


class Retries(StatefulProcessor):
    """``follow`` over the events (job_id, at_ms, event_id, event, retryable, delay_ms) of each job."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("job", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = before = tuple(self.state.get()) if self.state.exists() else ("", 0, -1)
        out = []
        for r in pd.concat(list(rows)).sort_values(["at_ms", "event_id"]).itertuples():
            held, made = follow(held, r.at_ms, r.event, bool(r.retryable), int(r.delay_ms), self.most)
            out += made
        if before[2] >= 0 and before[2] != held[2]:
            self.handle.deleteTimer(before[2])
        if held[2] >= 0 and held[2] != before[2]:
            self.handle.registerTimer(held[2])
        self.state.update(held)
        if out:
            yield _frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, attempts, due = self.state.get() if self.state.exists() else ("", 0, -1)
        if due == expiredTimerInfo.getExpiryTimeInMs():
            self.state.update((status, attempts, -1))
            yield _frame(key[0], [(due, "requeued", attempts, 0)])

    def close(self) -> None:
        pass


def retries(events: DataFrame, most: int = 3, late: str = "10 minutes") -> DataFrame:
    """(job_id, at_ms, event, attempt, delay_ms) of a stream (job_id, event_id, ts, event, retryable, delay_ms).

    ``requeued`` follows ``retry:created`` by its delay unless the job was started, cancelled or ended meanwhile;
    ``retry:max-attempts`` ends a job whose ``most`` attempts are used up, ``job:failed`` one that cannot be tried again.
    The session's state store must be RocksDB (``use_timers``). Null jobs are left out; events behind the watermark are lost.
    """
    at = events.filter(F.col("job_id").isNotNull()).withWatermark("ts", late).withColumn("at_ms", F.unix_millis("ts"))
    at = at.withColumn("retryable", F.coalesce("retryable", F.lit(False))).withColumn("delay_ms", F.coalesce("delay_ms", F.lit(0)).cast("long"))
    return at.groupBy("job_id").transformWithStateInPandas(Retries(most), OUT, "Append", "EventTime")


def use_timers(spark) -> None:
    """Sets the state store that state with timers needs, for streams that begin from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PLACE)
