"""Lifecycle event streams: status counts, feeds, state machines, retries, circuit breakers.

Streams carry (event_id, job_id, ts, event, value). Watermarks and de-duplication are additions of this engine.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.graph import Rounds

#: The transitions that a job may take.
NEXT = {"": ("queued",), "queued": ("running", "cancelled", "paused"), "running": ("completed", "failed", "cancelled", "paused"), "paused": ("queued", "running", "cancelled"), "completed": (), "failed": ("queued",), "cancelled": ()}
#: States that retention may forget.
ENDED = ("completed", "failed", "cancelled")
#: Messages of the activity feed by event.
MESSAGES = {"job:created": "created", "job:started": "started", "job:completed": "completed", "job:failed": "failed", "retry:created": "retry scheduled", "retry:max-attempts": "retries used up"}


def read_events(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """A stream over the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def status_counts(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events by kind, each event id once."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy("event").agg(F.count("*").alias("n"), F.max("ts").alias("last"))


def scan_counters(scans: DataFrame, least: float = 75.0) -> DataFrame:
    """One row over a stream of scans (ok, groups, suggestions, impacts): all, successful and failed scans, and what the
    successful ones found: groups, suggestions and groups of an impact of ``least`` or more. Nulls count 0."""
    ok = F.coalesce("ok", F.lit(False))
    of = lambda x: F.coalesce(F.sum(F.when(ok, x)), F.lit(0)).cast("long")
    high = F.size(F.filter("impacts", lambda x: x >= least))
    return scans.agg(F.count("*").alias("total_scans"), F.count_if(ok).alias("successful_scans"), F.count_if(~ok).alias("failed_scans"), of(F.col("groups")).alias("duplicates"), of(F.col("suggestions")).alias("suggestions"), of(F.greatest(high, F.lit(0))).alias("high_impact"))


def rolling_counts(events: DataFrame, late: str = "10 minutes", length: str = "1 hour", step: str = "15 minutes") -> DataFrame:
    """Events by kind in sliding windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, step), "event").agg(F.count("*").alias("n"))


def rate_windows(events: DataFrame, late: str = "10 minutes", length: str = "15 minutes", most: int = 500) -> DataFrame:
    """Requests of each client in fixed windows, and whether they go beyond ``most``."""
    n = F.count("*")
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "job_id").agg(n.alias("n"), (n > most).alias("limited"))


def activities(events: DataFrame) -> DataFrame:
    """Feed entries of the known events."""
    text = None
    for kind, what in MESSAGES.items():
        text = F.when(F.col("event") == kind, what) if text is None else text.when(F.col("event") == kind, what)
    message = F.concat(F.lit("Job "), F.col("job_id").cast("string"), F.lit(" "), text)
    return events.withColumn("message", message).filter(F.col("message").isNotNull())


def subscribed(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(client, event ...) for each subscription (client, channel) of the event's channel.

    A subscription to ``*`` is no pair with every event: it is one row a client in ``everything``.
    """
    return events.join(subscriptions.filter("channel <> '*'"), "channel").select("client", events["*"])


def everything(subscriptions: DataFrame) -> DataFrame:
    """The clients of ``*``, who read the whole event table."""
    return subscriptions.filter("channel = '*'").select("client").distinct()


def _turn(spark: SparkSession, path: str) -> int | None:
    """Which of a feed's two folders holds it; none before the first batch."""
    try:
        return int(spark.read.text(f"{path}/turn").first()["value"])
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def recent(spark: SparkSession, path: str) -> DataFrame:
    """The feed that ``keep_recent`` holds at ``path``."""
    return spark.read.parquet(f"{path}/{'ab'[_turn(spark, path)]}")


def keep_recent(rows: DataFrame, path: str, n: int = 50) -> None:
    """Merges a micro-batch into the feed at ``path``: the newest ``n``. For ``foreachBatch``; two folders take turns."""
    spark = rows.sparkSession
    turn = _turn(spark, path)
    both = rows if turn is None else recent(spark, path).unionByName(rows).dropDuplicates(["event_id"])
    new = 0 if turn is None else 1 - turn
    both.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(n).write.mode("overwrite").parquet(f"{path}/{'ab'[new]}")
    spark.createDataFrame([(str(new),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/turn")


JOB_STATE = T.StructType([T.StructField("status", T.StringType()), T.StructField("retries", T.LongType()), T.StructField("rejected", T.LongType())])
JOB_OUT = T.StructType([T.StructField("job_id", T.LongType()), *JOB_STATE.fields])


def step(status: str, retries: int, rejected: int, event: str) -> tuple[str, int, int]:
    """The state after an event: an illegal transition is counted and changes nothing; a requeue is a retry."""
    if event not in NEXT.get(status, ()):
        return status, retries, rejected + 1
    return event, retries + (status == "failed"), rejected


def _advance(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, retries, rejected = state.get if state.exists else ("", 0, 0)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    for event in rows["event"]:
        status, retries, rejected = step(status, retries, rejected, event)
    state.update((status, retries, rejected))
    yield pd.DataFrame({"job_id": [key[0]], "status": [status], "retries": [retries], "rejected": [rejected]})


def _advance_and_expire(keep_ms: int):
    """``_advance`` that forgets an ended job ``keep_ms`` after its last event, with a last row of status expired."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            _, retries, rejected = state.get
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "status": ["expired"], "retries": [retries], "rejected": [rejected]})
            return
        frames = list(batches)
        yield from _advance(key, iter(frames), state)
        if state.get[0] in ENDED:
            last = max(int(f["at_ms"].max()) for f in frames)
            state.setTimeoutTimestamp(max(last + keep_ms, state.getCurrentWatermarkMs() + 1))

    return run


def job_states(events: DataFrame, keep_seconds: float | None = None, late: str = "10 minutes") -> DataFrame:
    """The state of each job after each micro-batch, by the guarded state machine.

    With ``keep_seconds``, an ended job leaves the state so long after its last event, in event time, once the
    watermark (``late``) has passed; a later event of it starts anew. Without, state is kept for ever.
    """
    if keep_seconds is not None:
        grouped = events.withWatermark("ts", late).withColumn("at_ms", F.unix_millis("ts")).groupBy("job_id")
        return grouped.applyInPandasWithState(_advance_and_expire(int(keep_seconds * 1000)), JOB_OUT, JOB_STATE, "update", GroupStateTimeout.EventTimeTimeout)
    return events.groupBy("job_id").applyInPandasWithState(_advance, JOB_OUT, JOB_STATE, "update", GroupStateTimeout.NoTimeout)


def last_states(events: DataFrame) -> DataFrame:
    """The last event of each job, of a batch or a stream."""
    return events.groupBy("job_id").agg(F.max_by("event", F.struct("ts", "event_id")).alias("event"), F.max("ts").alias("ts"))


BREAKER_OUT = T.StructType([T.StructField("job_id", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("state", T.StringType()), T.StructField("failures", T.LongType())])


def breaker(rows: pd.DataFrame, threshold: int = 3, rest_seconds: float = 3600.0, held: tuple = ("CLOSED", 0, None)) -> tuple[pd.DataFrame, tuple]:
    """The state of a circuit breaker after each of a service's events, in order, and what it holds at the end.

    ``threshold`` failures in a row open it; the first event after ``rest_seconds`` finds it half open, where a success
    closes it and a failure opens it again. While it is open, events are not counted.
    """
    state, failures, opened = held
    states, counts = [], []
    for ts, ok in zip(rows["ts"], rows["ok"]):
        if state == "OPEN" and (ts - opened).total_seconds() >= rest_seconds:
            state = "HALF_OPEN"
        if state == "HALF_OPEN":
            state, failures, opened = ("CLOSED", 0, None) if ok else ("OPEN", failures + 1, ts)
        elif state == "CLOSED":
            failures = 0 if ok else failures + 1
            if failures >= threshold:
                state, opened = "OPEN", ts
        states.append(state)
        counts.append(failures)
    return pd.DataFrame({"job_id": rows["job_id"], "event_id": rows["event_id"], "state": states, "failures": counts}), (state, failures, opened)


def breaker_states(events: DataFrame, threshold: int = 3, rest_seconds: float = 3600.0) -> DataFrame:
    """``breaker`` for each service (job_id) of a table (job_id, event_id, ts, ok).

    A service's events are in one partition, sorted there by Spark, and pass through in batches of bounded size with the
    breaker's small state carried on; they are never gathered, however many they are.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, ("CLOSED", 0, None)
        for batch in batches:
            for job, rows in batch.groupby("job_id", sort=False, dropna=False):
                if last is None or not (job == last[0] or pd.isna(job) and pd.isna(last[0])):
                    held = ("CLOSED", 0, None)
                told, held = breaker(rows, threshold, rest_seconds, held)
                last = (job,)
                yield told

    rows = events.select("job_id", "event_id", "ts", "ok").repartition("job_id").sortWithinPartitions("job_id", "ts", "event_id")
    return rows.mapInPandas(run, BREAKER_OUT)


def retry_lineage(jobs: DataFrame) -> DataFrame:
    """(id, root, depth): the first job that each one retries, over ``retried_from``, and how many steps away it is.

    List ranking: each round every job jumps to where the job it points at points, and adds that one's steps, so the
    rounds are the logarithm of the longest chain. A parent that is not there is no step. Jobs on a cycle, or behind
    one, have no first job: their root and depth are null.
    """
    rounds = Rounds(jobs.sparkSession)
    there = jobs.select(F.col("id").alias("up")).distinct()
    linked = jobs.select("id", F.col("retried_from").alias("up")).join(there, "up", "left_semi")
    now = rounds.put(jobs.select("id").join(linked, "id", "left").select("id", F.coalesce("up", "id").alias("root"), F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long").alias("depth"), F.lit(True).alias("moved")))
    longest, reached = now.count(), 1
    while reached <= 2 * longest and not now.filter("moved").isEmpty():
        up = now.select(F.col("id").alias("at"), F.col("root").alias("next"), F.col("depth").alias("more"))
        now = rounds.put(now.join(up, F.col("root") == F.col("at")).select("id", F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved")))
        rounds.drop(rounds.n - 1)
        reached *= 2
    whole = ~F.col("moved")
    return now.select("id", F.when(whole, F.col("root")).alias("root"), F.when(whole, F.col("depth")).alias("depth"))
