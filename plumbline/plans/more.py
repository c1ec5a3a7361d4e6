"""Queries of the filters, the workflow and the reconstruction, with SQL written from their rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import filters, fits, ledger, openings, points, rebuild, segments, semantics, walls, workflow
from .catalog import _C, AUD, PTS, SEG, query
from .views import view

_TYPED = "SELECT segment_id, element_type, shape, point_count, min_x, max_x, min_y, max_y, min_z, max_z, cx, cy, cz, confidence, max_x - min_x AS w, max_y - min_y AS d, max_z - min_z AS h FROM c"


def _classified(spark, sf) -> DataFrame:
    return segments.classified(view(spark, sf, SEG))


# Filters -----------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {_C}, t2 AS (SELECT *, least(w, d, h) AS lo, greatest(w, d, h) AS hi, w + d + h - least(w, d, h) - greatest(w, d, h) AS mid FROM ({_TYPED}) q)
SELECT segment_id, CASE WHEN element_type = 'door' OR element_type = 'window' THEN NULL
  WHEN point_count < 0 THEN 'negative point_count' WHEN point_count = 0 AND shape <> 'void' THEN 'zero-point non-void segment'
  WHEN shape IN ('plane_vertical', 'plane_horizontal', 'plane_sloped') THEN CASE WHEN hi < 200 THEN 'major planar span < 200mm' WHEN mid < 30 THEN 'mid planar span < 30mm' WHEN lo < 0.5 THEN 'minor planar span < 0.5mm' END
  WHEN shape IN ('cylinder', 'valve_candidate') THEN CASE WHEN hi < 20 THEN 'major cylindrical span < 20mm' WHEN mid < 0.7 OR lo < 0.7 THEN 'minor cylindrical span < 0.7mm' END
  WHEN hi < 40 THEN 'major span < 40mm' WHEN shape <> 'void' AND mid < 20 THEN 'mid span < 20mm' WHEN shape <> 'void' AND lo < 3 THEN 'minor span < 3mm' END AS reason FROM t2""",
    SEG,
)
def segment_usability(spark, sf):
    return filters.usability(_classified(spark, sf)).select("segment_id", "reason")


@query("SELECT segment_id FROM segments_v WHERE shape = 'plane_horizontal' AND cz <= 1000 AND max_x - min_x >= 300 AND max_y - min_y >= 1000 AND max_z - min_z <= 250", SEG)
def implausible_trays(spark, sf):
    """Horizontal surfaces taken for trays, as the views have few of those."""
    trays = view(spark, sf, SEG).withColumn("element_type", F.when(F.col("shape") == "plane_horizontal", "cable_tray").otherwise("other"))
    return trays.filter(filters.implausible_tray()).select("segment_id")


@query(f"WITH {_C} SELECT segment_id FROM ({_TYPED}) q WHERE element_type = 'wall' AND greatest(w, d) >= 800 AND h >= 800 ORDER BY greatest(w, d) DESC, segment_id LIMIT 25", SEG)
def longest_walls(spark, sf):
    return filters.only_walls(_classified(spark, sf), 25).select("segment_id")


@query(f"WITH {_C} SELECT element_type, count(*) AS n FROM c WHERE element_type NOT IN ('tank', 'pump', 'hvac_equipment', 'pressure_vessel', 'heat_exchanger', 'compressor', 'pressurizer', 'steam_generator', 'emergency_diesel_generator', 'transformer', 'switchgear', 'ups_system') GROUP BY 1", SEG)
def without_containers(spark, sf):
    return filters.without_containers(_classified(spark, sf)).groupBy("element_type").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_C} SELECT segment_id, CASE WHEN run THEN 150.0E0 END AS diameter_mm, CASE WHEN run THEN cx - 75 ELSE min_x END AS min_x, CASE WHEN run THEN cy + 75 ELSE max_y END AS max_y
FROM (SELECT *, element_type IN ('pipe', 'duct', 'conduit', 'cable_tray') AS run FROM c) q""",
    SEG,
)
def uniform_pipe_diameter(spark, sf):
    return filters.uniform_diameter(_classified(spark, sf), 150.0).select("segment_id", "diameter_mm", "min_x", "max_y")


_NORMALS = "pl AS (SELECT k, CASE WHEN k % 11 = 0 THEN NULL ELSE (k % 7 - 3)::DOUBLE END AS nx, (k % 5 - 2)::DOUBLE AS ny, (k % 3)::DOUBLE * 2 AS nz FROM segments_v)"


def _planes(spark, sf) -> DataFrame:
    k = F.col("k")
    return view(spark, sf, SEG).select("k", F.when(k % 11 != 0, (k % 7 - 3).cast("double")).alias("nx"), (k % 5 - 2).cast("double").alias("ny"), ((k % 3) * 2).cast("double").alias("nz"))


@query(f"WITH {_NORMALS} SELECT k, CASE WHEN u < 0.25 THEN 'plane_vertical' WHEN u >= 0.85 THEN 'plane_horizontal' ELSE 'plane_sloped' END AS orientation FROM (SELECT k, CASE WHEN nx = 0 AND ny = 0 AND nz = 0 THEN 1 ELSE abs(nz) / sqrt(nx * nx + ny * ny + nz * nz) END AS u FROM pl WHERE nx IS NOT NULL) q", SEG)
def plane_orientations(spark, sf):
    rows = _planes(spark, sf).filter("nx IS NOT NULL")
    return rows.select("k", filters.orientation(filters.upness(F.col("nx"), F.col("ny"), F.col("nz"))).alias("orientation"))


@query(f"WITH {_NORMALS} SELECT k, CASE WHEN nx IS NULL THEN NULL WHEN u < 0.25 THEN 'vertical' WHEN u >= 0.85 THEN 'FLOOR_SLAB' ELSE 'SLOPED_SURFACE' END AS part FROM (SELECT *, CASE WHEN nx = 0 AND ny = 0 AND nz = 0 THEN 1 ELSE abs(nz) / sqrt(nx * nx + ny * ny + nz * nz) END AS u FROM pl) q", SEG)
def vertical_split(spark, sf):
    standing, others = filters.split_vertical(_planes(spark, sf))
    return standing.select("k", F.lit("vertical").alias("part")).unionByName(others.select("k", F.col("classification").alias("part")))


POSE = filters.Transform([[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]], [10.0, -4.0, 2.5], 0.5)


@query("SELECT point_id, round_even(2 * (y + 4), 6) AS x, round_even(-2 * (x - 10), 6) AS y, round_even(2 * (z - 2.5), 6) AS z FROM points_v", PTS)
def inverse_transform(spark, sf):
    return POSE.apply(view(spark, sf, PTS), back=True).select("point_id", *[F.bround(c, 6).alias(c) for c in "xyz"])


@query("SELECT 0.0E0 AS max_error, 0.0E0 AS mean_error")
def round_trip_error(spark, sf):
    return POSE.round_trip(view(spark, sf, PTS)).select(F.bround("max_error", 9).alias("max_error"), F.bround("mean_error", 9).alias("mean_error"))


@query("SELECT pose, faults FROM (VALUES ('good', ''), ('mirrored', 'determinant'), ('sheared', 'not_orthogonal,determinant'), ('flat', 'scale'), ('infinite', 'not_finite')) v(pose, faults)")
def transform_validity(spark, sf):
    turn = POSE.rotation.tolist()
    poses = {"good": POSE, "mirrored": filters.Transform([[1, 0, 0], [0, 1, 0], [0, 0, -1]], [0, 0, 0]), "sheared": filters.Transform([[1, 1, 0], [0, 2, 0], [0, 0, 1]], [0, 0, 0]), "flat": filters.Transform(turn, [0, 0, 0], 0.0), "infinite": filters.Transform(turn, [float("inf"), 0, 0])}
    # Which other faults a sheared pose has follows from these two.
    return spark.createDataFrame([(k, ",".join(f for f in p.faults() if f != "round_trip")) for k, p in poses.items()], "pose string, faults string")


@query(
    """WITH m AS (SELECT k, round_even((min_x / 1000 - 1.5) * 1000, 4) AS min_x, round_even((max_z / 1000 - 0.5) * 1000, 4) AS max_z, CASE WHEN k % 4 <> 0 THEN greatest(100, least(600, round_even((max_y - min_y), 4))) END AS thickness_mm, CASE WHEN k % 3 = 0 THEN NULL ELSE (k % 20) / 2.0 END AS s FROM segments_v)
SELECT k, min_x, max_z, thickness_mm, CASE WHEN s IS NULL THEN 'LOA10' WHEN s <= 0.05 THEN 'LOA50' WHEN s <= 0.5 THEN 'LOA40' WHEN s <= 2.5 THEN 'LOA30' WHEN s <= 7.5 THEN 'LOA20' ELSE 'LOA10' END AS loa_tier FROM m""",
    SEG,
)
def model_conversion(spark, sf):
    s = view(spark, sf, SEG)
    raw = s.select("k", *[(F.col(f"{e}_{a}") / 1000).alias(f"{e}_{a}") for a in "xyz" for e in ("min", "max")], F.when(F.col("k") % 4 != 0, (F.col("max_y") - F.col("min_y")) / 1000).alias("thickness_m"), F.when(F.col("k") % 3 != 0, (F.col("k") % 20) / 2000).alias("sigma_m"))
    return filters.to_model(raw, (1.5, 0.0, 0.5), "Z1").select("k", "min_x", "max_z", "thickness_mm", "loa_tier")


# Workflow ----------------------------------------------------------------------------------------------------------

_GATES = """gates AS (SELECT event_id AS gate_id, session_id, ts AS raised_at, CASE WHEN event_id % 3 = 0 THEN 'SC2' ELSE 'SC3' END AS safety_category FROM audit_v WHERE event_type = 'signup'),
dec AS (SELECT event_id AS decision_id, CASE event_type WHEN 'purchase' THEN event_id - 1 ELSE event_id - 2 END AS gate_id, value > 30 AS approved, concat('u', session_id) AS approver, ts FROM audit_v WHERE event_type IN ('purchase', 'click'))"""


def _gates(spark, sf) -> tuple[DataFrame, DataFrame]:
    e = view(spark, sf, AUD)
    gates = e.filter("event_type = 'signup'").select(F.col("event_id").alias("gate_id"), "session_id", F.col("ts").alias("raised_at"), F.when(F.col("event_id") % 3 == 0, "SC2").otherwise("SC3").alias("safety_category"))
    back = F.when(F.col("event_type") == "purchase", 1).otherwise(2)
    made = e.filter("event_type IN ('purchase', 'click')").select(F.col("event_id").alias("decision_id"), (F.col("event_id") - back).alias("gate_id"), (F.col("value") > 30).alias("approved"), F.concat(F.lit("u"), F.col("session_id")).alias("approver"), "ts")
    return gates, made


@query(
    f"""WITH {_GATES}, l AS (SELECT *, row_number() OVER (PARTITION BY gate_id ORDER BY ts DESC, decision_id DESC) AS r FROM dec)
SELECT g.gate_id, CASE WHEN l.gate_id IS NULL THEN 'PENDING' WHEN l.approved THEN 'APPROVED' ELSE 'REJECTED' END AS status, l.approver FROM gates g LEFT JOIN l ON l.gate_id = g.gate_id AND l.r = 1""",
    AUD,
)
def gate_decisions(spark, sf):
    return workflow.decided(*_gates(spark, sf)).select("gate_id", "status", "approver")


@query(f"WITH {_GATES} SELECT gate_id, safety_category FROM gates WHERE gate_id NOT IN (SELECT gate_id FROM dec)", AUD)
def pending_gates(spark, sf):
    return workflow.pending(*_gates(spark, sf)).select("gate_id", "safety_category")


@query(f"WITH {_GATES} SELECT decision_id, gate_id FROM dec WHERE NOT EXISTS (SELECT 1 FROM gates g WHERE g.gate_id = dec.gate_id)", AUD)
def unknown_decisions(spark, sf):
    return workflow.unknown_decisions(*_gates(spark, sf)).select("decision_id", "gate_id")


@query(f"WITH {_GATES}, e AS (SELECT gate_id, round_even((epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(raised_at::TIMESTAMP)) / 3.6e9, 4) AS hours FROM gates WHERE gate_id NOT IN (SELECT gate_id FROM dec)) SELECT gate_id, hours FROM e WHERE hours >= 24", AUD)
def escalated_gates(spark, sf):
    return workflow.escalated(*_gates(spark, sf), F.lit("2024-01-20 00:00:00").cast("timestamp")).select("gate_id", "hours")


_NCR = "st AS (SELECT session_id AS ncr_id, event_id AS step_id, ts, CASE event_type WHEN 'purchase' THEN 'RAISED' WHEN 'click' THEN 'RESOLVED' ELSE 'CLOSED' END AS action, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS r FROM audit_v WHERE event_type IN ('purchase', 'click', 'view'))"


@query(
    f"""WITH {_NCR}, a AS (SELECT ncr_id, min(r) AS t1 FROM st WHERE action = 'RAISED' GROUP BY 1), b AS (SELECT st.ncr_id, min(r) AS t2 FROM st JOIN a USING (ncr_id) WHERE action = 'RESOLVED' AND r > t1 GROUP BY 1), c AS (SELECT st.ncr_id, min(r) AS t3 FROM st JOIN b USING (ncr_id) WHERE action = 'CLOSED' AND r > t2 GROUP BY 1),
s AS (SELECT st.*, CASE WHEN r > t3 THEN 'CLOSED' WHEN r > t2 THEN 'RESOLVED' WHEN r > t1 THEN 'OPEN' ELSE 'NONE' END AS before, CASE WHEN r >= t3 THEN 'CLOSED' WHEN r >= t2 THEN 'RESOLVED' WHEN r >= t1 THEN 'OPEN' ELSE 'NONE' END AS after FROM st LEFT JOIN a USING (ncr_id) LEFT JOIN b USING (ncr_id) LEFT JOIN c USING (ncr_id))
SELECT ncr_id, step_id, action, before, after, before <> after OR (action = 'CLOSED' AND before = 'CLOSED') AS legal FROM s""",
    AUD,
)
def ncr_transitions(spark, sf):
    action = F.when(F.col("event_type") == "purchase", "RAISED").when(F.col("event_type") == "click", "RESOLVED").otherwise("CLOSED")
    steps = view(spark, sf, AUD).filter("event_type IN ('purchase', 'click', 'view')").select(F.col("session_id").alias("ncr_id"), F.col("event_id").alias("step_id"), "ts", action.alias("action"))
    return workflow.ncr_steps(steps).select("ncr_id", "step_id", "action", "before", "after", "legal")


def _ncrs(spark, sf) -> DataFrame:
    e = view(spark, sf, AUD).filter("event_type = 'error'")
    return e.select(F.col("event_id").alias("ncr_id"), "session_id", "ts", F.element_at(F.array(*map(F.lit, ("OPEN", "RESOLVED", "CLOSED"))), (F.col("event_id") % 3 + 1).cast("int")).alias("status"), F.when(F.col("value") > 80, "CRITICAL").when(F.col("value") > 30, "MAJOR").otherwise("MINOR").alias("severity"))


_NCRS = "n AS (SELECT event_id AS ncr_id, session_id, ts, CASE event_id % 3 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'RESOLVED' ELSE 'CLOSED' END AS status, CASE WHEN value > 80 THEN 'CRITICAL' WHEN value > 30 THEN 'MAJOR' ELSE 'MINOR' END AS severity FROM audit_v WHERE event_type = 'error')"


@query(f"WITH {_NCRS} SELECT session_id, count(*) AS total, sum((status = 'OPEN')::INT)::BIGINT AS open, sum((status = 'RESOLVED')::INT)::BIGINT AS resolved, sum((status = 'CLOSED')::INT)::BIGINT AS closed, sum((severity = 'CRITICAL')::INT)::BIGINT AS critical, sum((severity = 'MAJOR')::INT)::BIGINT AS major, sum((severity = 'MINOR')::INT)::BIGINT AS minor FROM n GROUP BY 1", AUD)
def ncr_summary(spark, sf):
    return workflow.ncr_summary(_ncrs(spark, sf))


@query(f"WITH {_NCRS} SELECT ncr_id, status, row_number() OVER (ORDER BY ts DESC, ncr_id DESC) AS place FROM n WHERE session_id = 7", AUD)
def newest_ncrs(spark, sf):
    """One session's list, so one task may number it."""
    return workflow.newest(_ncrs(spark, sf), 7).withColumn("place", F.monotonically_increasing_id() + 1).select("ncr_id", "status", "place").coalesce(1)


def _created(spark, sf) -> DataFrame:
    i = F.col("event_id")
    said = lambda name, p: F.when(i % p != 0, F.concat(F.lit(f'"{name}":"v'), i, F.lit('"'))).otherwise(F.lit(f'"{name}":""'))
    detail = F.concat(F.lit("{"), said("element_type", 5), F.lit(","), said("discipline", 7), F.lit(',"safety_category":"NS"}'))
    return view(spark, sf, AUD).filter("event_type = 'view'").select("session_id", F.concat(F.lit("e-"), i).alias("element_id"), detail.alias("detail"))


@query("SELECT session_id, count(*) AS verified, list_sort(coalesce(list('e-' || event_id) FILTER (event_id % 5 = 0 OR event_id % 7 = 0), [])) AS missing, count(*) FILTER (event_id % 5 = 0 OR event_id % 7 = 0) = 0 AS ok FROM audit_v WHERE event_type = 'view' GROUP BY 1", AUD)
def element_parameters(spark, sf):
    return workflow.parameters(_created(spark, sf))


def _typed_events(spark, sf) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "element_created").when(F.col("event_type") == "click", "element_blocked").otherwise("other")
    return view(spark, sf, AUD).select("session_id", kind.alias("event_type"), F.when(F.col("event_id") % 29 == 0, "SC1").otherwise("NS").alias("safety_category"))


_SAFE = f"""{_GATES}, ev AS (SELECT session_id, sum((event_type = 'view' AND event_id % 29 = 0)::INT)::BIGINT AS sc1_created, sum((event_type = 'click' AND event_id % 29 = 0)::INT)::BIGINT AS sc1_blocked FROM audit_v GROUP BY 1),
pd AS (SELECT session_id, count(*) AS p FROM gates WHERE safety_category = 'SC2' AND gate_id NOT IN (SELECT gate_id FROM dec) GROUP BY 1),
sc AS (SELECT session_id, sc1_created, sc1_blocked, coalesce(p, 0) AS sc2_pending, sc1_created = 0 AND p IS NULL AS ok FROM ev LEFT JOIN pd USING (session_id))"""


@query(f"WITH {_SAFE} SELECT * FROM sc", AUD)
def safety_checks(spark, sf):
    return workflow.safety_checks(_typed_events(spark, sf), workflow.pending(*_gates(spark, sf)))


@query(
    f"""WITH {_SAFE}, {_NCRS}, pa AS (SELECT session_id, count(*) FILTER (event_id % 5 = 0 OR event_id % 7 = 0) = 0 AS ok FROM audit_v WHERE event_type = 'view' GROUP BY 1), op AS (SELECT session_id, sum((status = 'OPEN')::INT) = 0 AS ok FROM n GROUP BY 1)
SELECT s.session_id, coalesce(pa.ok, true) AS parameters_ok, true AS chain_ok, s.ok AS safety_ok, coalesce(op.ok, true) AS ncrs_ok, coalesce(pa.ok, true) AND s.ok AND coalesce(op.ok, true) AS overall FROM sc s LEFT JOIN pa USING (session_id) LEFT JOIN op USING (session_id)""",
    AUD,
)
def verification_report(spark, sf):
    chain = view(spark, sf, AUD).select("session_id").distinct().withColumn("valid", F.lit(True))
    return workflow.verification(workflow.parameters(_created(spark, sf)), chain, safety_checks(spark, sf), workflow.ncr_summary(_ncrs(spark, sf)))


@query(
    """WITH s AS (SELECT session_id, count(*) FILTER (event_type = 'signup' AND value > 90) AS p, count(*) FILTER (event_type = 'error' AND value > 60) AS o, count(*) FILTER (event_type = 'click' AND value > 70) AS g, session_id % 5 <> 0 AS ok, CASE session_id % 3 WHEN 0 THEN 'SHARED' WHEN 1 THEN 'PUBLISHED' ELSE 'ARCHIVED' END AS target FROM audit_v GROUP BY 1),
b AS (SELECT session_id, target, CASE target WHEN 'SHARED' THEN [CASE WHEN p > 0 THEN p || ' instructions pending' END] WHEN 'PUBLISHED' THEN [CASE WHEN o > 0 THEN o || ' open NCR(s)' END, CASE WHEN g > 0 THEN g || ' SC2 gate(s) pending' END, CASE WHEN NOT ok THEN 'audit chain broken' END] ELSE ['unknown target ' || target] END AS l FROM s)
SELECT session_id, target, list_filter(l, lambda x: x IS NOT NULL) AS blockers, len(list_filter(l, lambda x: x IS NOT NULL)) = 0 AS can_transition FROM b""",
    AUD,
)
def release_blockers(spark, sf):
    some = lambda kind, least: F.count_if((F.col("event_type") == kind) & (F.col("value") > least))
    s = view(spark, sf, AUD).groupBy("session_id").agg(some("signup", 90).alias("pending"), some("error", 60).alias("open_ncrs"), some("click", 70).alias("sc2_pending"))
    target = F.element_at(F.array(*map(F.lit, ("shared", "Published", "ARCHIVED"))), (F.col("session_id") % 3 + 1).cast("int"))
    return workflow.release_blockers(s.withColumn("chain_ok", F.col("session_id") % 5 != 0), target)


@query(f"WITH {_NCRS} SELECT a.session_id, min(a.ts) AS created_at, max(a.ts) AS last_at, count(*) AS events, (SELECT count(*) FROM n WHERE n.session_id = a.session_id AND status = 'OPEN') AS open_ncrs, count(*) FILTER (event_type = 'view') AS views FROM audit_v a GROUP BY 1", AUD)
def session_list(spark, sf):
    return workflow.session_list(view(spark, sf, AUD), _ncrs(spark, sf)).withColumn("views", F.coalesce(F.try_element_at("by_type", F.lit("view")), F.lit(0))).drop("by_type")


@query("SELECT 'G' || p_size % 4 AS grade, count(*) AS n, count(*) FILTER (p_partkey % 9 = 0) AS untested, coalesce(string_agg('R' || p_partkey, ',' ORDER BY 'R' || p_partkey) FILTER (p_partkey % 9 = 0), '') AS missing FROM part GROUP BY 1")
def requirement_coverage(spark, sf):
    ids = F.when(F.col("p_partkey") % 9 != 0, F.array(F.col("p_name"))).otherwise(F.array().cast("array<string>"))
    return workflow.requirement_coverage(view(spark, sf, "part").select(F.concat(F.lit("R"), "p_partkey").alias("req_id"), F.concat(F.lit("G"), F.col("p_size") % 4).alias("grade"), ids.alias("test_ids")))


@query("SELECT segment_id, CASE WHEN k % 10 < 8 THEN confidence ELSE 1.0E0 END AS confidence FROM segments_v", SEG)
def confidence_lookup(spark, sf):
    s = view(spark, sf, SEG)
    return workflow.confidences(s.select("segment_id"), s.filter("k % 10 < 8")).select("segment_id", "confidence")


@query("SELECT segment_id, shape FROM segments_v WHERE shape <> 'plane_vertical' UNION ALL SELECT 'wall-' || k % 20, 'wall' FROM segments_v WHERE shape = 'plane_vertical' GROUP BY 1", SEG)
def rebuilt_rows(spark, sf):
    s = view(spark, sf, SEG)
    made = s.filter("shape = 'plane_vertical'").select(F.concat(F.lit("wall-"), F.col("k") % 20).alias("segment_id"), F.lit("wall").alias("shape"), F.col("segment_id").alias("source"))
    return workflow.replaced(s.select("segment_id", "shape"), made)


@query("SELECT event_type, count(*) AS n FROM audit_v GROUP BY 1", AUD)
def safety_breakdown(spark, sf):
    return ledger.stats(view(spark, sf, AUD)).select("event_type", "n")


# Reconstruction ----------------------------------------------------------------------------------------------------


def _rods(spark, sf) -> DataFrame:
    """Points on eight pipes along x, of 5 to 40 cm radius, that rise by a tenth of what they go along."""
    k, i = F.col("o_orderkey"), F.col("o_orderkey") % 8
    along, turn, r = (k * 7919 % 4000) / 1000.0, F.radians((k * 104729 % 360).cast("double")), (i + 1) * 0.05
    return view(spark, sf, "orders").select(k.alias("point_id"), i.alias("rod"), along.alias("x"), (i * 3 + r * F.cos(turn)).alias("y"), (along * 0.1 + r * F.sin(turn)).alias("z"))


@query()
def pipe_fits(spark, sf):
    return rebuild.pipes(rebuild.measured(_rods(spark, sf), "rod"), "rod")


@query()
def duct_fits(spark, sf):
    return rebuild.ducts(rebuild.measured(_rods(spark, sf), "rod"), "rod")


@query()
def cable_tray_fits(spark, sf):
    return rebuild.cable_trays(rebuild.measured(_rods(spark, sf), "rod"), "rod")


@query()
def valve_fits(spark, sf):
    return rebuild.valves(rebuild.measured(_rods(spark, sf), "rod"), "rod")


@query()
def oriented_boxes(spark, sf):
    return rebuild.oriented_boxes(rebuild.measured(view(spark, sf, PTS), "surface"), "surface")


@query()
def patch_features(spark, sf):
    return rebuild.patch_features(rebuild.measured(view(spark, sf, PTS), "surface"), "surface")


@query()
def wall_fits(spark, sf):
    return rebuild.validated_walls(rebuild.walls(view(spark, sf, PTS), "surface"))


@query(
    """WITH t AS (SELECT i, i * pi() / 2 / 44 AS a FROM range(45) r(i)), s AS (SELECT surface, i, a, count(*) AS n, min(z) AS z0, max(z) AS z1, min(x * cos(a) + y * sin(a)) AS u0, max(x * cos(a) + y * sin(a)) AS u1, min(y * cos(a) - x * sin(a)) AS v0, max(y * cos(a) - x * sin(a)) AS v1 FROM points_v, t GROUP BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY round_even((u1 - u0) * (v1 - v0), 12), i) AS r FROM s), c AS (SELECT *, (u0 + u1) / 2 * cos(a) - (v0 + v1) / 2 * sin(a) AS mx, (u0 + u1) / 2 * sin(a) + (v0 + v1) / 2 * cos(a) AS my FROM b WHERE r = 1 AND n >= 25 AND z1 - z0 >= 0.6 AND u1 - u0 >= 0.08 AND v1 - v0 >= 0.08),
d AS (SELECT surface, stddev_pop(sqrt((x - mx) ** 2 + (y - my) ** 2)) / avg(sqrt((x - mx) ** 2 + (y - my) ** 2)) AS cv FROM points_v JOIN c USING (surface) GROUP BY 1)
SELECT surface, n, round_even(mx, 4) AS centre_x, round_even(my, 4) AS centre_y, round_even((z0 + z1) / 2, 4) AS centre_z, round_even(u1 - u0, 4) AS width_m, round_even(v1 - v0, 4) AS depth_m, round_even(z1 - z0, 4) AS height_m, round_even(degrees(a), 4) AS degrees, CASE WHEN cv < 0.12 AND least(u1 - u0, v1 - v0) / greatest(u1 - u0, v1 - v0) > 0.85 THEN 'CIRCULAR' ELSE 'RECTANGULAR' END AS profile FROM c JOIN d USING (surface)""",
    PTS,
)
def column_fits(spark, sf):
    return rebuild.columns(view(spark, sf, PTS), "surface")


@query()
def slab_fits(spark, sf):
    slabs = view(spark, sf, PTS).filter("surface = 4").withColumn("slab", F.when(F.col("z") < 1.5, 0).otherwise(1))
    return rebuild.validated_slabs(rebuild.slabs(slabs, "slab"))


@query()
def outline_polygons(spark, sf):
    return fits.polygons(view(spark, sf, PTS), "surface").select("surface", "n", "corners", F.bround("area", 4).alias("area_m2"))


@query(
    """WITH p AS (SELECT o_orderkey % 8 AS rod, o_orderkey % 8 * 3 + (o_orderkey % 8 + 1) * 0.05 * cos(radians(o_orderkey * 104729 % 360)) AS y, (o_orderkey * 7919 % 4000) / 1000.0 * 0.1 + (o_orderkey % 8 + 1) * 0.05 * sin(radians(o_orderkey * 104729 % 360)) AS z, (o_orderkey * 7919 % 4000) / 1000.0 AS x FROM orders)
SELECT rod, round_even(sqrt(avg((sqrt(pow(y - rod * 3, 2) + pow(z - 0.2, 2)) - 0.1) ** 2)) * 1000, 4) AS sigma_mm FROM p GROUP BY 1"""
)
def cylinder_deviation(spark, sf):
    """Distances from a level cylinder of 10 cm radius about each pipe's mid height."""
    axes = spark.range(8).select(F.col("id").alias("rod"), F.lit(0.0).alias("px"), (F.col("id") * 3.0).alias("py"), F.lit(0.2).alias("pz"), F.lit(1.0).alias("ax"), F.lit(0.0).alias("ay"), F.lit(0.0).alias("az"), F.lit(0.1).alias("radius"))
    return rebuild.cylinder_sigma(_rods(spark, sf), "rod", axes)


_ELEMENTS = "el AS (SELECT k, point_count AS n, (max_x - min_x) / 1000 AS l, (max_z - min_z) / 1000 AS h, (max_y - min_y) / 1000 AS t, k % 9 / 20.0 AS e FROM segments_v)"


def _elements(spark, sf) -> DataFrame:
    size = lambda a: (F.col(f"max_{a}") - F.col(f"min_{a}")) / 1000
    return view(spark, sf, SEG).select("k", F.col("point_count").alias("n"), size("x").alias("length_m"), size("z").alias("height_m"), size("y").alias("thickness_m"), (F.col("k") % 9 / 20).alias("rmse_m"), size("x").alias("width_m"), size("y").alias("depth_m"), (F.col("k") % 6).alias("corners"))


_STATUS = "CASE WHEN len(reasons) = 0 THEN 'ACCEPTED' WHEN n < {} THEN 'REJECTED_SUPPORT' ELSE 'REJECTED_GEOMETRY' END AS status"


@query(f"WITH {_ELEMENTS} SELECT k, reasons, {_STATUS.format(25)} FROM (SELECT k, n, list_filter([CASE WHEN l <= 0.15 THEN 'length' END, CASE WHEN h <= 0.3 THEN 'height' END, CASE WHEN t < 0.04 OR t > 1.2 THEN 'thickness' END, CASE WHEN n < 25 THEN 'support' END, CASE WHEN e > greatest(0.1, t / 2 + 0.04) THEN 'residual' END], lambda x: x IS NOT NULL) AS reasons FROM el) q", SEG)
def wall_validity(spark, sf):
    return rebuild.validated_walls(_elements(spark, sf)).select("k", "reasons", "status")


@query(f"WITH {_ELEMENTS} SELECT k, reasons, {_STATUS.format(25)} FROM (SELECT k, n, list_filter([CASE WHEN l <= 0.06 OR t <= 0.06 THEN 'cross_section' END, CASE WHEN h <= 0.4 THEN 'height' END, CASE WHEN n < 25 THEN 'support' END], lambda x: x IS NOT NULL) AS reasons FROM el) q", SEG)
def column_validity(spark, sf):
    return rebuild.validated_columns(_elements(spark, sf)).select("k", "reasons", "status")


@query(f"WITH {_ELEMENTS} SELECT k, reasons, {_STATUS.format(20)} FROM (SELECT k, n, list_filter([CASE WHEN k % 6 < 3 THEN 'outline' END, CASE WHEN t < 0.05 OR t > 1.5 THEN 'thickness' END, CASE WHEN n < 20 THEN 'support' END], lambda x: x IS NOT NULL) AS reasons FROM el) q", SEG)
def slab_validity(spark, sf):
    return rebuild.validated_slabs(_elements(spark, sf)).select("k", "reasons", "status")


_LINES = "ln AS (SELECT k, k % 12 * 2.0 AS start_x, k % 7 * 2.0 AS start_y, k % 12 * 2.0 + k % 5 AS end_x, k % 7 * 2.0 + k % 3 * 0.2 AS end_y FROM segments_v WHERE k <= 400)"


@query(f"WITH {_LINES}, e AS (SELECT k, start_x AS x, start_y AS y FROM ln UNION ALL SELECT k, end_x, end_y FROM ln) SELECT DISTINCT p.k AS a, q.k AS b FROM e p JOIN e q ON p.k < q.k AND (p.x - q.x) ** 2 + (p.y - q.y) ** 2 < 0.1225", SEG)
def wall_l_junctions(spark, sf):
    k = F.col("k")
    lines = view(spark, sf, SEG).filter("k <= 400").select("k", (k % 12 * 2.0).alias("start_x"), (k % 7 * 2.0).alias("start_y"), (k % 12 * 2.0 + k % 5).alias("end_x"), (k % 7 * 2.0 + k % 3 * 0.2).alias("end_y"))
    return rebuild.l_junctions(lines, "k")


@query(
    """WITH n AS (SELECT a.point_id, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) AS d FROM points_v a JOIN points_v b ON a.point_id <> b.point_id GROUP BY 1), m AS (SELECT greatest(0.005, least(1.0, median(d))) AS s FROM n WHERE d > 1e-6), l AS (SELECT s, greatest(0.02, least(3.0, s * 2.5)) AS r FROM m), o AS (SELECT s, r, greatest(r * 1.5, least(8.0, s * 8)) AS q FROM l)
SELECT round_even(s, 6) AS spacing, round_even(r, 6) AS local, round_even(q, 6) AS middle, round_even(greatest(q * 1.5, least(25.0, s * 25)), 6) AS whole FROM o""",
    PTS,
)
def multi_scale_radii(spark, sf):
    return points.multi_scale_radii(view(spark, sf, PTS)).select(*[F.bround(c, 6).alias(c) for c in ("spacing", "local", "middle", "whole")])


@query("SELECT count(*) AS parts, min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y, sum(point_count)::BIGINT AS points, 2800.0E0 AS min_z, 3000.0E0 AS max_z FROM segments_v WHERE shape = 'plane_horizontal' AND abs(cz - 3000) <= 500 HAVING count(*) > 0", SEG)
def floor_slabs(spark, sf):
    return walls.slabs_at(view(spark, sf, SEG), 3000.0)


@query("SELECT wall, min_z, max_z, 0.0E0 = min_z AND max_z = 3000 AS spans FROM (SELECT 0::BIGINT AS wall, 0.0E0 AS min_z, 3000.0E0 AS max_z) q")
def storey_wall_span(spark, sf):
    """Every wall of the storey spans it, whatever its fragments do; and there are as many groups as without a span."""
    s = view(spark, sf, SEG)
    found = walls.between_levels(s, 0.0, 3000.0)
    plain = walls.wall_groups(s.filter("shape = 'plane_vertical' AND min_z < 3000 AND max_z > 0"), 120.0)
    apart = found.join(plain.select("wall"), "wall", "full").agg(F.count_if(F.col("min_z").isNull()).alias("wall")).crossJoin(found.agg(F.min("min_z").alias("min_z"), F.max("max_z").alias("max_z")))
    return apart.withColumn("spans", (F.col("min_z") == 0) & (F.col("max_z") == 3000))


@query(
    """WITH w AS (SELECT *, max_x - min_x >= max_y - min_y AS ax FROM segments_v WHERE shape = 'plane_vertical' AND k % 21 = 0), e AS (SELECT min(min_x) AS x0, max(max_x) AS x1, min(min_y) AS y0, max(max_y) AS y1 FROM w),
s AS (SELECT 'south' AS side, x0 AS min_x, x1 AS max_x, y0 - 100 AS min_y, y0 + 100 AS max_y, EXISTS (SELECT 1 FROM w WHERE ax AND abs(cy - y0) <= 600) AS has FROM e UNION ALL SELECT 'north', x0, x1, y1 - 100, y1 + 100, EXISTS (SELECT 1 FROM w WHERE ax AND abs(cy - y1) <= 600) FROM e
UNION ALL SELECT 'west', x0 - 100, x0 + 100, y0, y1, EXISTS (SELECT 1 FROM w WHERE NOT ax AND abs(cx - x0) <= 600) FROM e UNION ALL SELECT 'east', x1 - 100, x1 + 100, y0, y1, EXISTS (SELECT 1 FROM w WHERE NOT ax AND abs(cx - x1) <= 600) FROM e)
SELECT side, min_x, max_x, min_y, max_y, 0.0E0 AS min_z, 3000.0E0 AS max_z FROM s WHERE NOT has""",
    SEG,
)
def enclosure_walls(spark, sf):
    return walls.missing_sides(view(spark, sf, SEG).filter("shape = 'plane_vertical' AND k % 21 = 0"), 0.0, 3000.0)


# Openings, pairs, ends and guesses ---------------------------------------------------------------------------------


def _faces(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Two walls of 8 by 3 m, a door and a window left out of each."""
    k, wall = F.col("o_orderkey"), F.col("o_orderkey") % 2
    i = F.explode(F.sequence(F.lit(0), F.lit(39)))
    p = view(spark, sf, "orders").select(k, wall.alias("wall"), i.alias("i")).withColumn("n", F.col("o_orderkey") * 40 + F.col("i"))
    p = p.select("wall", (F.pmod(F.xxhash64("n"), F.lit(8000)) / 1000).alias("x"), (F.col("wall") * 5.0).alias("y"), (F.pmod(F.xxhash64("n", F.lit(1)), F.lit(3000)) / 1000).alias("z"))
    p = p.filter("NOT (x > 1.5 AND x < 2.5 AND z < 2.5) AND NOT (x > 4.5 AND x < 6.0 AND z > 0.4 AND z < 2.7)")
    return p, spark.range(2).select(F.col("id").alias("wall"), F.lit(0.0).alias("start_x"), (F.col("id") * 5.0).alias("start_y"), F.lit(8.0).alias("end_x"), (F.col("id") * 5.0).alias("end_y"), F.lit(0.0).alias("base_m"), F.lit(3.0).alias("height_m"), F.lit(0.2).alias("thickness_m"))


@query()
def wall_openings(spark, sf):
    return openings.wall_openings(*_faces(spark, sf), "wall")


@query()
def paired_faces(spark, sf):
    s = view(spark, sf, SEG).filter("shape = 'plane_vertical'")
    return openings.paired(walls.face_candidates(s).select("a", "b", F.col("distance_mm").alias("distance")))


_ENDS = "ln AS (SELECT k, k % 12 * 2.0 AS start_x, k % 7 * 2.0 AS start_y, k % 12 * 2.0 + CASE k % 2 WHEN 0 THEN 1.7 ELSE 0.1 END AS end_x, k % 7 * 2.0 + CASE k % 2 WHEN 0 THEN 0.1 ELSE 1.8 END AS end_y FROM segments_v WHERE k <= 100)"


@query(
    f"""WITH {_ENDS}, e AS (SELECT k, 'start' AS part, start_x AS x, start_y AS y, start_x AS x1, start_y AS y1, end_x AS x2, end_y AS y2 FROM ln UNION ALL SELECT k, 'end', end_x, end_y, start_x, start_y, end_x, end_y FROM ln),
j AS (SELECT e.*, l.k AS other, l.start_x AS x3, l.start_y AS y3, l.end_x AS x4, l.end_y AS y4, (x1 - x2) * (l.start_y - l.end_y) - (y1 - y2) * (l.start_x - l.end_x) AS den, degrees(atan2(y2 - y1, x2 - x1)) AS t1, degrees(atan2(l.end_y - l.start_y, l.end_x - l.start_x)) AS t2 FROM e JOIN ln l ON e.k <> l.k),
q AS (SELECT *, ((x1 * y2 - y1 * x2) * (x3 - x4) - (x1 - x2) * (x3 * y4 - y3 * x4)) / den AS px, ((x1 * y2 - y1 * x2) * (y3 - y4) - (y1 - y2) * (x3 * y4 - y3 * x4)) / den AS py FROM j WHERE abs(den) >= 1e-8 AND abs(t1 - t2) BETWEEN 45 AND 135),
b AS (SELECT *, row_number() OVER (PARTITION BY k, part ORDER BY round_even(sqrt((px - x) ** 2 + (py - y) ** 2), 9), other) AS r FROM q WHERE sqrt((px - x) ** 2 + (py - y) ** 2) <= 0.4 AND px BETWEEN least(x3, x4) - 0.4 AND greatest(x3, x4) + 0.4 AND py BETWEEN least(y3, y4) - 0.4 AND greatest(y3, y4) + 0.4)
SELECT ln.k, count(b.k) AS moved FROM ln LEFT JOIN b ON b.k = ln.k AND r = 1 GROUP BY 1""",
    SEG,
)
def snapped_walls(spark, sf):
    k = F.col("k")
    even = k % 2 == 0
    lines = view(spark, sf, SEG).filter("k <= 100").select("k", (k % 12 * 2.0).alias("start_x"), (k % 7 * 2.0).alias("start_y"), (k % 12 * 2.0 + F.when(even, 1.7).otherwise(0.1)).alias("end_x"), (k % 7 * 2.0 + F.when(even, 0.1).otherwise(1.8)).alias("end_y"))
    return openings.snapped(lines, "k").select("k", F.col("moved").cast("long").alias("moved"))


@query(
    """WITH s AS (SELECT k, CASE k % 4 WHEN 0 THEN 0.55 * (k % 100) / 100.0 + 0.45 * (k % 7) / 7.0 ELSE (k % 100) / 100.0 END AS wall, CASE k % 4 WHEN 0 THEN 0.55 * (k % 50) / 50.0 ELSE (k % 50) / 50.0 END AS pipe FROM segments_v)
SELECT k, CASE WHEN greatest(wall, pipe) >= 0.45 AND abs(wall - pipe) >= 0.10 THEN CASE WHEN wall > pipe THEN 'WALL' ELSE 'PIPE' END ELSE 'UNKNOWN' END AS label, round_even(greatest(wall, pipe), 6) AS score FROM s""",
    SEG,
)
def open_world_labels(spark, sf):
    k = F.col("k")
    rows = view(spark, sf, SEG).select("k", F.create_map(F.lit("WALL"), (k % 100) / 100.0, F.lit("PIPE"), (k % 50) / 50.0).alias("geometric"), F.when(k % 4 == 0, F.create_map(F.lit("WALL"), (k % 7) / 7.0)).alias("neural"))
    return semantics.open_world(rows).select("k", "label", F.bround("score", 6).alias("score"))


@query("SELECT segment_id, confidence * CASE WHEN shape = 'void' AND k % 3 = 0 THEN 0.4 WHEN shape = 'cylinder' AND k % 2 = 0 THEN 0.6 ELSE 1 END AS confidence FROM segments_v", SEG)
def rule_confidence(spark, sf):
    k = F.col("k")
    kind = F.when(F.col("shape") == "void", "door").when(F.col("shape") == "cylinder", "pipe").otherwise("wall")
    nodes = view(spark, sf, SEG).withColumns({"element_type": kind, "host": F.when(k % 3 != 0, "w"), "connections": F.when(k % 2 != 0, F.array(F.lit("p")))})
    return semantics.enforced(nodes).select("segment_id", "confidence")


@query("SELECT segment_id, min_z + s AS min_z, cz + s AS cz FROM (SELECT *, round_even((min_z + max_z) / 2 / 3000, 0) * 3000 - (min_z + max_z) / 2 AS s FROM segments_v) q", SEG)
def floor_bands(spark, sf):
    return semantics.banded(view(spark, sf, SEG)).select("segment_id", "min_z", "cz")


@query("SELECT k, round_even(greatest(0, least(1, 0.35 * least(1, point_count / 1800.0) + 0.25 * least(1, (max_x - min_x) * (max_z - min_z) / 1e6 / 12) + 0.2 * greatest(0, 1 - (k % 10) / 20.0 / 0.3) + 0.2 * greatest(0, least(1, 1 - CASE WHEN k % 5 = 0 THEN 0.05 ELSE (k % 8) / 100.0 END / 0.06)))), 6) AS confidence FROM segments_v", SEG)
def cloud_wall_confidence(spark, sf):
    area = (F.col("max_x") - F.col("min_x")) * (F.col("max_z") - F.col("min_z")) / 1e6
    k = F.col("k")
    return view(spark, sf, SEG).select("k", E.round_even(semantics.wall_confidence(F.col("point_count"), area, (k % 10) / 20, F.when(k % 5 != 0, (k % 8) / 100)), 6).alias("confidence"))


@query("SELECT segment_id, shape AS label, shape IN ('cylinder', 'box') AND k % 2 = 0 AS valid FROM segments_v", SEG)
def label_claims(spark, sf):
    claims = view(spark, sf, SEG).select("segment_id", F.when(F.col("k") % 2 == 0, "pipes").otherwise("walls").alias("model"), F.col("shape").alias("label"))
    space = spark.createDataFrame([("pipes", "cylinder"), ("pipes", "box"), ("walls", "wall"), ("pipes", "box")], "model string, label string")
    return semantics.claimed(claims, space).select("segment_id", "label", "valid")
