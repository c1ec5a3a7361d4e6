"""Workflow over an event ledger: gate decisions, the life of non-conformances, release checks, verification and session reports.

Tables: decisions and gates by gate_id, ledger events by (session_id, ts, event_id). Each operator is one grouping, window or join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What a created element's event has to say.
REQUIRED = ("element_type", "discipline", "safety_category")
#: The states that a step may follow; a step of another order is refused and changes nothing.
STEPS = {"RAISED": ("NONE",), "RESOLVED": ("OPEN",), "CLOSED": ("RESOLVED", "CLOSED")}


def decided(gates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Gates with status APPROVED, REJECTED or PENDING by their last decision (gate_id, approved, approver, ts, decision_id), and who made it."""
    last = decisions.groupBy("gate_id").agg(F.max_by(F.struct("approved", "approver"), F.struct("ts", "decision_id")).alias("d"))
    status = F.when(F.col("d").isNull(), "PENDING").when(F.col("d.approved"), "APPROVED").otherwise("REJECTED")
    return gates.join(last, "gate_id", "left").withColumns({"status": status, "approver": F.col("d.approver")}).drop("d")


def pending(gates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Gates that nobody has decided."""
    return gates.join(decisions.select("gate_id").distinct(), "gate_id", "left_anti")


def unknown_decisions(gates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions on gates that don't exist."""
    return decisions.join(gates.select("gate_id").distinct(), "gate_id", "left_anti")


def escalated(gates: DataFrame, decisions: DataFrame, now: Column, hours: float = 24.0) -> DataFrame:
    """Pending gates raised (raised_at) that many hours ago or more."""
    return pending(gates, decisions).withColumn("hours", F.bround((F.unix_micros(now) - F.unix_micros(F.col("raised_at").cast("timestamp"))) / 3.6e9, 4)).filter(F.col("hours") >= hours)


def ncr_steps(steps: DataFrame) -> DataFrame:
    """Each step (ncr_id, action RAISED, RESOLVED or CLOSED, ts, step_id) with the state before it, whether it is legal, and the state after.

    Only OPEN ones are resolved and only resolved ones closed, once raised. As the state is one of a few, it follows from counts:
    the first RAISED, the first RESOLVED after it, the first CLOSED after that. So it is windows, not a fold.
    """
    order = W.partitionBy("ncr_id").orderBy("ts", "step_id")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    out = steps
    ever = F.lit(True)
    for action in ("RAISED", "RESOLVED", "CLOSED"):
        good = ever & (F.col("action") == action)
        out = out.withColumn(f"now_{action}", F.coalesce(F.max(good.cast("int")).over(upto), F.lit(0)) == 1)
        out = out.withColumn(f"had_{action}", F.coalesce(F.max(good.cast("int")).over(before), F.lit(0)) == 1)
        ever = F.col(f"had_{action}")
        # What comes next has to come after this step.
    state = lambda p: F.when(F.col(f"{p}_CLOSED"), "CLOSED").when(F.col(f"{p}_RESOLVED"), "RESOLVED").when(F.col(f"{p}_RAISED"), "OPEN").otherwise("NONE")
    out = out.withColumns({"before": state("had"), "after": state("now")})
    legal = F.lit(False)
    for action, states in STEPS.items():
        legal = legal | ((F.col("action") == action) & F.col("before").isin(*states))
    return out.withColumn("legal", legal).drop(*[f"{p}_{a}" for p in ("now", "had") for a in STEPS])


def ncr_summary(ncrs: DataFrame) -> DataFrame:
    """By session: total, and how many of each status and severity (rows with session_id, status, severity)."""
    return ncrs.groupBy("session_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("OPEN", "RESOLVED", "CLOSED")], *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("CRITICAL", "MAJOR", "MINOR")])


def newest(ncrs: DataFrame, session_id: int, only_open: bool = False) -> DataFrame:
    """A session's non-conformances, newest first."""
    own = ncrs.filter(F.col("session_id") == session_id)
    return (own.filter("status = 'OPEN'") if only_open else own).orderBy(F.col("ts").desc(), F.col("ncr_id").desc())


def parameters(created: DataFrame) -> DataFrame:
    """By session: created elements, those whose detail (JSON) lacks a required value, and whether none does."""
    said = [F.get_json_object("detail", f"$.{k}") for k in REQUIRED]
    bad = F.lit(False)
    for s in said:
        bad = bad | s.isNull() | s.isin("", "null", "false", "0")
    return created.groupBy("session_id").agg(F.count("*").alias("verified"), F.array_sort(F.collect_list(F.when(bad, F.col("element_id")))).alias("missing")).withColumn("ok", F.size("missing") == 0)


def safety_checks(events: DataFrame, gates_pending: DataFrame) -> DataFrame:
    """By session: no SC1 element was created, no SC2 gate is pending, and how many SC1 elements were blocked.

    Events have session_id, event_type and safety_category; gates_pending has session_id and safety_category.
    """
    sc1 = F.col("safety_category") == "SC1"
    of = events.groupBy("session_id").agg(F.count_if(sc1 & (F.col("event_type") == "element_created")).alias("sc1_created"), F.count_if(sc1 & (F.col("event_type") == "element_blocked")).alias("sc1_blocked"))
    open_ = gates_pending.filter("safety_category = 'SC2'").groupBy("session_id").agg(F.count("*").alias("sc2_pending"))
    return of.join(open_, "session_id", "left").withColumn("sc2_pending", F.coalesce("sc2_pending", F.lit(0))).withColumn("ok", (F.col("sc1_created") == 0) & (F.col("sc2_pending") == 0))


def verification(params: DataFrame, chain: DataFrame, safety: DataFrame, open_ncrs: DataFrame) -> DataFrame:
    """One row a session of any of the checks: each verdict and all of them together. A check without a row has nothing to object to.

    params and safety have session_id and ok, chain has session_id and valid, open_ncrs has session_id and open.
    """
    parts = [params.select("session_id", F.col("ok").alias("parameters_ok")), chain.select("session_id", F.col("valid").alias("chain_ok")), safety.select("session_id", F.col("ok").alias("safety_ok")), open_ncrs.select("session_id", (F.col("open") == 0).alias("ncrs_ok"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "session_id", "full")
    names = ("parameters_ok", "chain_ok", "safety_ok", "ncrs_ok")
    out = out.select("session_id", *[F.coalesce(c, F.lit(True)).alias(c) for c in names])
    return out.withColumn("overall", F.col(names[0]) & F.col(names[1]) & F.col(names[2]) & F.col(names[3]))


def release_blockers(sessions: DataFrame, target: Column) -> DataFrame:
    """session_id, target, blockers and can_transition for rows with pending, open_ncrs, sc2_pending and chain_ok."""
    to = F.upper(target)
    said = lambda c, text: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(text)))
    published = F.array(said("open_ncrs", " open NCR(s)"), said("sc2_pending", " SC2 gate(s) pending"), F.when(~F.col("chain_ok"), F.lit("audit chain broken")))
    found = F.when(to == "SHARED", F.array(said("pending", " instructions pending"))).when(to == "PUBLISHED", published).otherwise(F.array(F.concat(F.lit("unknown target "), to)))
    return sessions.withColumns({"target": to, "blockers": F.array_compact(found)}).select("session_id", "target", "blockers", (F.size("blockers") == 0).alias("can_transition"))


def session_list(events: DataFrame, ncrs: DataFrame) -> DataFrame:
    """Dashboard rows: by session its first and last event, events by type as a map, open non-conformances; the newest first."""
    types = events.groupBy("session_id", "event_type").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    one = types.groupBy("session_id").agg(F.min("a").alias("created_at"), F.max("b").alias("last_at"), F.sum("n").alias("events"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("by_type"))
    open_ = ncrs.filter("status = 'OPEN'").groupBy("session_id").agg(F.count("*").alias("open_ncrs"))
    return one.join(open_, "session_id", "left").withColumn("open_ncrs", F.coalesce("open_ncrs", F.lit(0))).orderBy(F.col("created_at").desc(), "session_id")


def requirement_coverage(requirements: DataFrame) -> DataFrame:
    """By grade: requirements (req_id, grade, test_ids), those without a test, and their ids."""
    none = F.coalesce(F.size("test_ids"), F.lit(0)) <= 0
    return requirements.groupBy("grade").agg(F.count("*").alias("n"), F.count_if(none).alias("untested"), F.array_join(F.array_sort(F.collect_list(F.when(none, F.col("req_id")))), ",").alias("missing"))


def confidences(instructions: DataFrame, segments: DataFrame) -> DataFrame:
    """Instructions with the confidence of their segment, 1 where there is none."""
    return instructions.join(segments.select("segment_id", F.col("confidence").alias("found")), "segment_id", "left").withColumn("confidence", F.coalesce("found", F.lit(1.0))).drop("found")


def replaced(rows: DataFrame, rebuilt: DataFrame, key: str = "segment_id") -> DataFrame:
    """Rebuilt rows in place of their sources (column `source`), each rebuilt row once; other rows as they are."""
    return rows.join(rebuilt.select(F.col("source").alias(key)).distinct(), key, "left_anti").unionByName(rebuilt.drop("source").dropDuplicates([key]), allowMissingColumns=True)
