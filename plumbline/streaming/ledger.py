"""The ledger as a stream: idempotent append, hash chains kept as state, event rates."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ledger import iso

OUT = "event_id long, session_id long, event_type string, ts timestamp, previous_hash string, event_hash string"


def once(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event id once, as long as a repetition comes within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def rates(events: DataFrame, width: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """Events and their value by window and type; later events than the watermark are left out. `late` is None where events have a watermark already."""
    w = (events.withWatermark("ts", late) if late else events).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def chained(events: DataFrame, secret: bytes) -> DataFrame:
    """Appends each session's events to its chain: the state holds the last hash, and a batch's events go in order of time and id.

    Chaining is sequential in a session by its nature; sessions are independent, and a batch brings a bounded part of each.
    """

    def link(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        previous = state.get[0] if state.exists else None
        before, own = [], []
        for head in rows["head"]:
            before.append(previous)
            previous = hmac.new(secret, f"{head}{previous or ''}".encode(), hashlib.sha256).hexdigest()
            own.append(previous)
        state.update((previous,))
        yield pd.DataFrame({"event_id": rows["event_id"], "session_id": key[0], "event_type": rows["event_type"], "ts": rows["ts"], "previous_hash": pd.Series(before, index=rows.index, dtype=object), "event_hash": own})

    head = F.concat_ws("|", F.col("event_id").cast("string"), F.col("session_id").cast("string"), "event_type", iso(F.col("ts")), F.lit(""))
    return events.select("event_id", "session_id", "event_type", "ts", head.alias("head")).groupBy("session_id").applyInPandasWithState(link, OUT, "last string", "append", GroupStateTimeout.NoTimeout)
