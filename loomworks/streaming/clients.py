"""What clients hold: their channels, and their lists of jobs and activity, as state over ordered messages."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MOST_CHANNELS, LONGEST_CHANNEL, MOST_ACTIVITY = 50, 128, 100
_CHANNEL = re.compile(r"[a-zA-Z0-9_:.-]+")
CHANNELS_OUT = T.StructType([T.StructField("client", T.LongType()), T.StructField("message_id", T.LongType()), T.StructField("added", T.ArrayType(T.StringType())), T.StructField("rejected", T.IntegerType()), T.StructField("dropped", T.IntegerType())])
LISTS_OUT = T.StructType([T.StructField("client", T.LongType()), T.StructField("queued", T.ArrayType(T.StringType())), T.StructField("active", T.ArrayType(T.StringType())), T.StructField("activity", T.ArrayType(T.StringType())), T.StructField("unread", T.LongType())])
_HELD = T.StructType([T.StructField("held", T.StringType())])


def subscribe(held: list[str], channels: list, most: int = MOST_CHANNELS, longest: int = LONGEST_CHANNEL) -> tuple[list[str], list[str], int, int]:
    """A client's channels after a message that asks for ``channels``; those newly added, and how many of the asked ones
    are not names and how many are beyond ``most``. A name asked for again takes a place of its message all the same."""
    good = [c for c in channels if isinstance(c, str) and len(c) <= longest and _CHANNEL.fullmatch(c)]
    taken = good[: most - len(held)]
    new = list(dict.fromkeys(c for c in taken if c not in held))
    return held + new, new, len(channels) - len(good), len(good) - len(taken)


def fold(lists: dict, event: str, job: str, most: int = MOST_ACTIVITY) -> dict:
    """A client's lists after an event of a job: it is queued, moves from queued to active, or leaves.

    A start adds to the active jobs whether or not it was queued; completion and failure take it from the active jobs
    alone, cancellation from both. Each of these goes first in the activity, of which ``most`` stay, and counts as
    unread until ``read``; ``clear`` empties activity and count. Other events change nothing.
    """
    without = lambda x: [j for j in x if j != job]
    queued, active, activity, unread = lists["queued"], lists["active"], lists["activity"], lists["unread"]
    if event == "queued":
        queued = [*queued, job]
    elif event == "running":
        queued, active = without(queued), [*active, job]
    elif event in ("completed", "failed"):
        active = without(active)
    elif event == "cancelled":
        queued, active = without(queued), without(active)
    elif event == "read":
        return {**lists, "unread": 0}
    elif event == "clear":
        return {**lists, "activity": [], "unread": 0}
    else:
        return lists
    return {"queued": queued, "active": active, "activity": [f"{job}:{event}", *activity][:most], "unread": unread + 1}


EMPTY = {"queued": [], "active": [], "activity": [], "unread": 0}


def _channels(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held, out = json.loads(state.get[0]) if state.exists else [], []
    for r in pd.concat(list(batches)).sort_values("message_id").itertuples():
        held, new, rejected, dropped = subscribe(held, list(r.channels) if r.channels is not None else [])
        out.append((key[0], r.message_id, new, rejected, dropped))
    state.update((json.dumps(held),))
    yield pd.DataFrame(out, columns=CHANNELS_OUT.names)


def _lists(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = json.loads(state.get[0]) if state.exists else EMPTY
    for r in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
        held = fold(held, r.event, str(r.job_id))
    state.update((json.dumps(held),))
    yield pd.DataFrame([(key[0], held["queued"], held["active"], held["activity"], held["unread"])], columns=LISTS_OUT.names)


def channels(messages: DataFrame) -> DataFrame:
    """What each message (client, message_id, channels) of a stream adds: (client, message_id, added, rejected, dropped).

    Names are 1 to 128 letters, digits or ``_:.-``; a client has 50 at most. Its state is their list.
    """
    return messages.groupBy("client").applyInPandasWithState(_channels, CHANNELS_OUT, _HELD, "append", GroupStateTimeout.NoTimeout)


def lists(events: DataFrame) -> DataFrame:
    """The lists of each client (``fold``) after each micro-batch of (client, event_id, ts, event, job_id)."""
    return events.groupBy("client").applyInPandasWithState(_lists, LISTS_OUT, _HELD, "update", GroupStateTimeout.NoTimeout)


def deliver(events: DataFrame, added: DataFrame) -> DataFrame:
    """(client, event ...): each event (channel ...), of a batch or a stream, to the clients of its channel in ``added``
    (client, added). Clients of ``*`` have all events; see ``lifecycle.everything``."""
    subscriptions = added.select("client", F.explode("added").alias("channel")).distinct()
    return events.join(subscriptions.filter("channel <> '*'"), "channel").select("client", *[events[c] for c in events.columns])
