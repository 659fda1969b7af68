"""Streams: orphan references as keyed state, and counts of denied requests by window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Order of events at one moment: loads and deletions before references, as in the batch operator.
_ORDER = {"load": 0, "delete": 0, "reference": 1}
_OUT = "key string, at timestamp, event string, n bigint"


def orphan_changes(events: DataFrame) -> DataFrame:
    """Stream of (key, at, event, n) from events(key, at, kind) with kinds reference, load and delete.

    State of a key: how many rows hold it and how many references wait. A reference to a key that is not held opens an orphan, the
    arrival of a parent resolves all that wait, the deletion of the last one reopens every reference so far. The state is three
    numbers whatever the number of references; events of one micro-batch are put in order of time.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, asked, waiting = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(frames))
        rows = rows.assign(_o=rows["kind"].map(_ORDER)).sort_values(["at", "_o"], kind="stable")
        out = []
        for at, kind in zip(rows["at"], rows["kind"]):
            if kind == "reference":
                asked += 1
                if held <= 0:
                    waiting += 1
                    out.append((key[0], at, "opened", 1))
            elif kind == "load":
                held += 1
                if waiting and held > 0:
                    out.append((key[0], at, "resolved", waiting))
                    waiting = 0
            else:
                held -= 1
                if held == 0 and asked > waiting:
                    out.append((key[0], at, "reopened", asked - waiting))
                    waiting = asked
        state.update((held, asked, waiting))
        yield pd.DataFrame(out, columns=["key", "at", "event", "n"])

    return events.groupBy("key").applyInPandasWithState(update, _OUT, "held bigint, asked bigint, waiting bigint", "append", GroupStateTimeout.NoTimeout)


def denied_by_window(events: DataFrame, window: str = "1 hour", late: str = "2 days") -> DataFrame:
    """(start, end, n, denied) of audit events(ingested_at, status, request_id); a request sent again within the allowed lateness counts once."""
    once = events.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["request_id"])
    counted = once.groupBy(F.window("ingested_at", window)).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "DENIED").alias("denied"))
    return counted.select("window.start", "window.end", "n", "denied")
