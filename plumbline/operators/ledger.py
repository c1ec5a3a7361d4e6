"""The append-only audit ledger: hash chains, gates, non-conformances, release states."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

IPAD, OPAD = 0x36, 0x5C


def hmac_sha256(secret: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a string column as lower-case hex, from native hashing of binary columns."""
    key = secret if len(secret) <= 64 else hashlib.sha256(secret).digest()
    key = key + bytes(64 - len(key))
    inner, outer = (F.unhex(F.lit(bytes(b ^ p for b in key).hex())) for p in (IPAD, OPAD))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def iso(ts: Column) -> Column:
    """Text of a UTC timestamp: microseconds only where there are any, and the offset."""
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(F.lit("")), F.lit("+00:00"))


def _message(previous: Column) -> Column:
    return F.concat_ws("|", F.col("event_id").cast("string"), F.col("session_id").cast("string"), "event_type", iso(F.col("ts")), F.coalesce(previous, F.lit("")))


def chained(events: DataFrame, secret: bytes) -> DataFrame:
    """Adds previous_hash and event_hash: each event's HMAC holds that of the one before it in its session, by time and id.

    A chain is sequential within a session; sessions are independent and are dealt over tasks. A session's events pass
    through one task in order, in Arrow batches, not as one group in memory.
    """
    rows = events.select("event_id", "session_id", "event_type", "ts", F.concat_ws("|", F.col("event_id").cast("string"), F.col("session_id").cast("string"), "event_type", iso(F.col("ts")), F.lit("")).alias("head"))
    rows = rows.repartition("session_id").sortWithinPartitions("session_id", "ts", "event_id")

    def link(batches):
        session, previous = None, None
        for pdf in batches:
            before, own = [], []
            for s, head in zip(pdf["session_id"], pdf["head"], strict=True):
                if s != session:
                    session, previous = s, None
                before.append(previous)
                previous = hmac.new(secret, f"{head}{previous or ''}".encode(), hashlib.sha256).hexdigest()
                own.append(previous)
            yield pd.DataFrame({"event_id": pdf["event_id"], "session_id": pdf["session_id"], "event_type": pdf["event_type"], "ts": pdf["ts"], "previous_hash": pd.Series(before, dtype=object), "event_hash": own})

    return rows.mapInPandas(link, "event_id long, session_id long, event_type string, ts timestamp, previous_hash string, event_hash string")


def verified(chain: DataFrame, secret: bytes) -> DataFrame:
    """Broken events with the reason: hash_mismatch where the HMAC isn't that of the row, chain_break where the link is not to the row before."""
    order = W.partitionBy("session_id").orderBy("ts", "event_id")
    rows = chain.withColumn("before", F.lag("event_hash").over(order)).withColumn("i", F.row_number().over(order))
    reason = F.when(F.col("event_hash") != hmac_sha256(secret, _message(F.col("previous_hash"))), "hash_mismatch").when((F.col("i") > 1) & ~F.col("previous_hash").eqNullSafe(F.col("before")), "chain_break")
    return rows.select("session_id", "event_id", reason.alias("reason")).filter("reason IS NOT NULL")


def stats(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def by_session(events: DataFrame, session_id: int) -> DataFrame:
    return events.filter(F.col("session_id") == session_id).orderBy("ts", "event_id")


# Events stand for the steps of a non-conformance: which type opens, resolves or closes it.
NCR = {"purchase": "OPEN", "click": "RESOLVED", "view": "CLOSED"}


def last_state(events: DataFrame, states: dict[str, str] = NCR) -> DataFrame:
    """The state of each session's non-conformance: that of its last event that has one."""
    state = F.create_map(*(F.lit(x) for kv in states.items() for x in kv))
    rows = events.withColumn("state", F.try_element_at(state, F.col("event_type"))).filter("state IS NOT NULL")
    return rows.groupBy("session_id").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("steps"))


def release(sessions: DataFrame) -> DataFrame:
    """What a session may become: rows with session_id, pending, open_ncr, pending_gates, chain_ok."""
    shared = F.col("pending") == 0
    published = shared & (F.col("open_ncr") == 0) & (F.col("pending_gates") == 0) & F.col("chain_ok")
    return sessions.select("session_id", F.when(published, "PUBLISHED").when(shared, "SHARED").otherwise("WIP").alias("may_be"))


def gates(instructions: DataFrame, signed: Column | None = None) -> DataFrame:
    """Where the safety gate sends each instruction: SC1 blocked, SC2 pending unless signed, else passed."""
    ok = F.lit(False) if signed is None else signed
    return instructions.withColumn("gate", F.when(F.col("safety_category") == "SC1", "blocked").when((F.col("safety_category") == "SC2") & ~ok, "pending").otherwise("passed"))


def execution(instructions: DataFrame) -> DataFrame:
    """By zone: created, blocked, pending, minor non-conformances (created and unsure), and whether the zone is complete."""
    g = gates(instructions)
    out = g.groupBy("zone_id").agg(F.count_if(F.col("gate") == "passed").alias("created"), F.count_if(F.col("gate") == "blocked").alias("blocked"), F.count_if(F.col("gate") == "pending").alias("pending"), F.count_if((F.col("gate") == "passed") & (F.col("confidence") < 0.60)).alias("ncr_minor"))
    return out.withColumn("completed", (F.col("blocked") == 0) & (F.col("pending") == 0))


ROLES = ("PREPARER", "VERIFIER", "APPROVER")


def signatures_valid(signatures: DataFrame) -> DataFrame:
    """Rows with session_id, seq, role, signer, previous_hash, hash: whether roles come in order, once each, by different signers, and link up."""
    order = W.partitionBy("session_id").orderBy("seq")
    rank = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role"))
    rows = signatures.withColumns({"i": F.row_number().over(order), "before": F.lag("hash").over(order), "rank": rank, "same": F.count("*").over(W.partitionBy("session_id", "signer"))})
    bad = (F.col("rank") != F.col("i")) | (F.col("same") > 1) | ~F.col("previous_hash").eqNullSafe(F.col("before"))
    return rows.groupBy("session_id").agg((F.max(bad.cast("int")) == 0).alias("valid"), F.count("*").alias("n"))
