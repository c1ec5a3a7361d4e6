"""Queries over the driver's tables, one for each operator, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import clusters, fits, ledger, mep, metrics, points, quality, segments, semantics, spatial, vectors, walls
from ..sources import tables
from . import rules_sql
from .views import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL over the named views."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_views(sql, *views)
        return f

    return add


SEG, PTS, DES, STA, AUD, LAB = "segments_v", "points_v", "design_v", "stations_v", "audit_v", "labels_v"
_M = rules_sql.SIZED
_C = rules_sql.CLASSIFIED
_LOA = "CASE WHEN 2 * {0} <= 0.1 THEN 'LOA50' WHEN 2 * {0} <= 1 THEN 'LOA40' WHEN 2 * {0} <= 5 THEN 'LOA30' WHEN 2 * {0} <= 15 THEN 'LOA20' ELSE 'LOA10' END"
_RICS = "CASE WHEN {0} <= 3 AND {1} >= 0.9 THEN {2} WHEN {0} <= 10 AND {1} >= 0.8 THEN {3} WHEN {0} <= 50 AND {1} >= 0.6 THEN {4} ELSE {5} END"


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    return segments.classified(view(spark, sf, SEG))


# Segments ----------------------------------------------------------------------------------------------------------


@query(f"WITH {_C} SELECT segment_id, element_type, discipline, safety_category, dsear_zone FROM c", SEG)
def classify_segments(spark, sf):
    return _classified(spark, sf).select("segment_id", "element_type", "discipline", "safety_category", "dsear_zone")


@query(f"WITH {_C} SELECT zone_id, discipline, element_type, count(*) AS n, sum(point_count)::BIGINT AS points, round_even(avg(confidence), 4) AS mean_confidence FROM c GROUP BY 1, 2, 3", SEG)
def element_counts(spark, sf):
    return _classified(spark, sf).groupBy("zone_id", "discipline", "element_type").agg(F.count("*").alias("n"), F.sum("point_count").alias("points"), F.bround(F.avg("confidence"), 4).alias("mean_confidence"))


@query(f"WITH {_M} SELECT segment_id, {rules_sql.VIABLE} AS reason FROM m", SEG)
def viability(spark, sf):
    return segments.viability(view(spark, sf, SEG)).select("segment_id", "reason")


@query(f"WITH {_M} SELECT segment_id, {rules_sql.VALID} AS reason FROM m", SEG)
def geometry_validity(spark, sf):
    return segments.validity(view(spark, sf, SEG)).select("segment_id", "reason")


_ORDER = "CASE WHEN element_type IN ('wall', 'bund_wall') THEN 0 WHEN shape IN ('cylinder', 'valve_candidate', 'box', 'void') THEN 1 ELSE 2 END"
_RANK = "CASE shape WHEN 'plane_vertical' THEN 0 WHEN 'void' THEN 1 WHEN 'cylinder' THEN 2 WHEN 'valve_candidate' THEN 3 WHEN 'box' THEN 4 WHEN 'plane_sloped' THEN 5 WHEN 'plane_horizontal' THEN 6 ELSE 99 END"


@query(f"WITH {_C} SELECT segment_id, phase, shape_rank, row_number() OVER (ORDER BY phase, shape_rank, -confidence, -point_count, cz, cx, cy, segment_id) AS seq FROM (SELECT *, {_ORDER} AS phase, {_RANK} AS shape_rank FROM c) q", SEG)
def instruction_order(spark, sf):
    return segments.instruction_order(_classified(spark, sf))


@query(f"WITH {_M} SELECT segment_id, min_e AS minor_mm, mid_e AS mid_mm, max_e AS major_mm, round_even((min_e + mid_e) / 2, 1) AS diameter_mm, round_even(max_e / greatest(mid_e, 1), 3) AS aspect FROM m", SEG)
def geometry_parameters(spark, sf):
    return segments.measured(view(spark, sf, SEG)).select("segment_id", F.col("min_e").alias("minor_mm"), F.col("mid_e").alias("mid_mm"), F.col("max_e").alias("major_mm"), F.bround((F.col("min_e") + F.col("mid_e")) / 2, 1).alias("diameter_mm"), F.bround(F.col("max_e") / F.greatest("mid_e", F.lit(1)), 3).alias("aspect"))


@query("SELECT zone_id, CASE WHEN r <= 3 THEN zone_id ELSE 'zone-overflow' END AS target, count(*) AS n FROM (SELECT zone_id, dense_rank() OVER (ORDER BY f, zone_id) AS r FROM (SELECT zone_id, min(k) OVER (PARTITION BY zone_id) AS f FROM segments_v) q) q GROUP BY 1, 2", SEG)
def zone_decomposition(spark, sf, most: int = 3):
    zones = view(spark, sf, SEG).groupBy("zone_id").agg(F.min("k").alias("f"), F.count("*").alias("n"))
    # A row for each zone is left, so one task may rank them.
    return zones.withColumn("r", F.dense_rank().over(W.orderBy("f", "zone_id"))).select("zone_id", F.when(F.col("r") <= most, F.col("zone_id")).otherwise("zone-overflow").alias("target"), "n")


@query("SELECT segment_id, part AS piece, round_even(min_x + part * (max_x - min_x) / parts, 6) AS piece_min_x, round_even(min_x + (part + 1) * (max_x - min_x) / parts, 6) AS piece_max_x FROM (SELECT *, unnest(generate_series(0, parts - 1)) AS part FROM (SELECT *, CAST(ceil((max_x - min_x) / 3000) AS BIGINT) AS parts FROM segments_v) q) q", SEG)
def split_large_elements(spark, sf, most_mm: float = 3000.0):
    df = view(spark, sf, SEG).withColumn("parts", F.ceil(E.extent("x") / most_mm)).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    at = lambda i: F.bround(F.col("min_x") + i * E.extent("x") / F.col("parts"), 6)
    return df.select("segment_id", "piece", at(F.col("piece")).alias("piece_min_x"), at(F.col("piece") + 1).alias("piece_max_x"))


ROTATION = [[0.6, -0.8, 0.0, 1000.0], [0.8, 0.6, 0.0, -500.0], [0.0, 0.0, 1.0, 250.0]]


@query(
    """WITH corner AS (SELECT k, px * 0.6 - py * 0.8 + 1000 AS x, px * 0.8 + py * 0.6 - 500 AS y, pz + 250 AS z FROM (SELECT k, unnest([min_x, max_x]) AS px, min_y, max_y, min_z, max_z FROM segments_v) a, (SELECT 0) b, LATERAL (SELECT unnest([min_y, max_y]) AS py) c, LATERAL (SELECT unnest([min_z, max_z]) AS pz) d)
SELECT k, round_even(min(x), 4) AS min_x, round_even(max(x), 4) AS max_x, round_even(min(y), 4) AS min_y, round_even(max(y), 4) AS max_y, round_even(min(z), 4) AS min_z, round_even(max(z), 4) AS max_z FROM corner GROUP BY k""",
    SEG,
)
def rigid_transform(spark, sf):
    """All eight corners of each box are moved and boxed again, without exploding them."""
    df = view(spark, sf, SEG)
    corners = [E.affine(F.col(a), F.col(b), F.col(c), ROTATION) for a in ("min_x", "max_x") for b in ("min_y", "max_y") for c in ("min_z", "max_z")]
    out = [F.col("k")]
    for i, axis in enumerate("xyz"):
        out += [F.bround(F.least(*(c[i] for c in corners)), 4).alias(f"min_{axis}"), F.bround(F.greatest(*(c[i] for c in corners)), 4).alias(f"max_{axis}")]
    return df.select(*out)


@query("WITH o AS (SELECT (min(cx) + max(cx)) / 2 AS ox, (min(cy) + max(cy)) / 2 AS oy, min(min_z) AS oz FROM segments_v) SELECT k, round_even(cx - ox, 4) AS cx, round_even(cy - oy, 4) AS cy, round_even(cz - oz, 4) AS cz FROM segments_v, o", SEG)
def survey_centering(spark, sf):
    df = view(spark, sf, SEG)
    o = df.agg(((F.min("cx") + F.max("cx")) / 2).alias("ox"), ((F.min("cy") + F.max("cy")) / 2).alias("oy"), F.min("min_z").alias("oz"))
    return df.crossJoin(F.broadcast(o)).select("k", *[F.bround(F.col(f"c{a}") - F.col(f"o{a}"), 4).alias(f"c{a}") for a in "xyz"])


@query(
    """SELECT k, i, round_even(CASE WHEN shape = 'cylinder' THEN cx + (max_x - min_x + max_y - min_y) / 4 * cos(2 * pi() * i / 12) ELSE CASE WHEN i IN (0, 3) THEN min_x ELSE max_x END END, 4) AS x,
 round_even(CASE WHEN shape = 'cylinder' THEN cy + (max_x - min_x + max_y - min_y) / 4 * sin(2 * pi() * i / 12) ELSE CASE WHEN i IN (0, 1) THEN min_y ELSE max_y END END, 4) AS y
FROM (SELECT *, unnest(generate_series(0, CASE WHEN shape = 'cylinder' THEN 11 ELSE 3 END)) AS i FROM segments_v WHERE min_z <= 1250 AND max_z >= 1150) q""",
    SEG,
)
def floor_plan_slice(spark, sf, elevation_mm: float = 1200.0, thickness_mm: float = 100.0):
    """Outline corners of the boxes that a slice meets; cylinders get twelve."""
    df = view(spark, sf, SEG).filter((F.col("min_z") <= elevation_mm + thickness_mm / 2) & (F.col("max_z") >= elevation_mm - thickness_mm / 2))
    df = df.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("shape") == "cylinder", F.lit(11)).otherwise(F.lit(3)).cast("long"))))
    r, angle = (E.extent("x") + E.extent("y")) / 4, 2 * F.pi() * F.col("i") / 12
    x = F.when(F.col("shape") == "cylinder", F.col("cx") + r * F.cos(angle)).when(F.col("i").isin(0, 3), F.col("min_x")).otherwise(F.col("max_x"))
    y = F.when(F.col("shape") == "cylinder", F.col("cy") + r * F.sin(angle)).when(F.col("i").isin(0, 1), F.col("min_y")).otherwise(F.col("max_y"))
    return df.select("k", "i", F.bround(x, 4).alias("x"), F.bround(y, 4).alias("y"))


@query("SELECT bin, sum(point_count)::BIGINT AS weight, count(*) AS planes FROM (SELECT *, CAST(floor(CASE WHEN max_x - min_x >= max_y - min_y THEN 0 ELSE 90 END / 10.0) AS BIGINT) AS bin FROM segments_v WHERE shape = 'plane_vertical') q GROUP BY 1", SEG)
def dominant_orientation(spark, sf):
    return points.dominant_orientation(view(spark, sf, SEG))


@query(
    """WITH h AS (SELECT cz, point_count, k, CASE WHEN cz - lag(cz) OVER (ORDER BY cz, k) <= 350 THEN 0 ELSE 1 END AS new FROM segments_v WHERE shape = 'plane_horizontal'),
g AS (SELECT *, sum(new) OVER (ORDER BY cz, k ROWS UNBOUNDED PRECEDING) AS grp FROM h)
SELECT CAST(grp AS BIGINT) AS cluster, count(*) AS n, round_even(sum(cz * point_count) / sum(point_count), 1) AS level_mm FROM g GROUP BY 1""",
    SEG,
)
def level_clusters(spark, sf):
    return walls.level_clusters(view(spark, sf, SEG)).select("cluster", "n", "level_mm")


# Joins -------------------------------------------------------------------------------------------------------------

_GAP = "greatest(a.min_{0}, b.min_{0}) - least(a.max_{0}, b.max_{0})"
_CL = f"greatest({', '.join(_GAP.format(a) for a in 'xyz')})"
_SET = lambda x: "(" + ", ".join(f"'{v}'" for v in x) + ")"
_EITHER = lambda x, y: f"((a.element_type IN {_SET(x)} AND b.element_type IN {_SET(y)}) OR (b.element_type IN {_SET(x)} AND a.element_type IN {_SET(y)}))"
_WHITE = rules_sql.ALLOWED


@query(f"WITH {_C} SELECT a.segment_id AS a_id, b.segment_id AS b_id, a.zone_id, CASE WHEN {_CL} < 0 THEN 'hard' ELSE 'soft' END AS clash_type, round_even({_CL}, 1) AS clearance_mm FROM c a JOIN c b ON a.k < b.k AND {_CL} < 20 AND NOT {_WHITE}", SEG)
def clash_detection(spark, sf):
    return spatial.clashes(_classified(spark, sf))


@query(f"WITH {_C} SELECT a.zone_id, CASE WHEN {_CL} < 0 THEN 'hard' ELSE 'soft' END AS clash_type, count(*) AS n FROM c a JOIN c b ON a.k < b.k AND {_CL} < 20 AND NOT {_WHITE} GROUP BY 1, 2", SEG)
def clash_summary(spark, sf):
    return spatial.clash_counts(_classified(spark, sf))


_VOL = "(({0}.max_x - {0}.min_x) * ({0}.max_y - {0}.min_y) * ({0}.max_z - {0}.min_z))"
_INT = " * ".join(f"greatest(-({_GAP.format(a)}), 0)" for a in "xyz")


@query(f"SELECT a.k AS a, b.k AS b, round_even(i / (va + vb - i), 6) AS iou, round_even(i / least(va, vb), 6) AS containment FROM (SELECT a, b, {_INT} AS i, {_VOL.format('a')} AS va, {_VOL.format('b')} AS vb FROM segments_v a JOIN segments_v b ON a.k < b.k AND {_CL} < 0) q", SEG)
def overlapping_boxes(spark, sf):
    df = view(spark, sf, SEG)
    return spatial.box_pairs(df, df).filter((F.col("a.k") < F.col("b.k")) & (E.intersection() > 0)).select(F.col("a.k").alias("a"), F.col("b.k").alias("b"), F.bround(E.iou(), 6).alias("iou"), F.bround(E.containment(), 6).alias("containment"))


_DIST = "sqrt((s.cx - d.dx) ** 2 + (s.cy - d.dy) ** 2 + (s.cz - d.dz) ** 2)"
_DEV = f"""WITH pair AS (SELECT d.global_id, s.segment_id, {_DIST} AS distance FROM design_v d, segments_v s),
best AS (SELECT global_id, arg_min(segment_id, (distance, segment_id)) AS segment_id, min(distance) AS distance FROM pair GROUP BY 1),
near AS (SELECT segment_id, min(distance) AS distance FROM pair GROUP BY 1),
r AS (SELECT global_id, CASE WHEN distance < 150 THEN segment_id END AS segment_id, CASE WHEN distance < 25 THEN 'MATCHED' WHEN distance < 150 THEN 'SHIFTED' ELSE 'MISSING' END AS status, CASE WHEN distance < 150 THEN round_even(distance, 3) END AS distance_mm FROM best
UNION ALL SELECT NULL, segment_id, 'EXTRA', NULL FROM near WHERE distance >= 150)
"""


@query(_DEV + "SELECT * FROM r", SEG, DES)
def deviation_report(spark, sf):
    return spatial.deviation(view(spark, sf, DES), view(spark, sf, SEG))


@query(_DEV + "SELECT CASE WHEN distance_mm IS NULL THEN 'unknown' WHEN distance_mm < 5 THEN 'lt5' WHEN distance_mm < 15 THEN '5_15' WHEN distance_mm < 50 THEN '15_50' ELSE 'ge50' END AS bucket, count(*) AS n FROM r GROUP BY 1", SEG, DES)
def deviation_heatmap(spark, sf):
    return quality.heatmap(spatial.deviation_counts(view(spark, sf, DES), view(spark, sf, SEG)), "n")


_MEP = "e AS (SELECT a.k AS a, b.k AS b, sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 + (a.cz - b.cz) ** 2) AS d FROM segments_v a JOIN segments_v b ON a.k < b.k AND a.shape IN ('cylinder', 'box', 'valve_candidate') AND b.shape IN ('cylinder', 'box', 'valve_candidate') AND abs(a.cx - b.cx) <= 1000 AND abs(a.cy - b.cy) <= 1000 AND abs(a.cz - b.cz) <= 1000)"


@query(f"WITH {_MEP} SELECT a, b, round_even(d, 3) AS distance_mm FROM e WHERE d <= 1000", SEG)
def mep_proximity(spark, sf):
    return spatial.mep_edges(view(spark, sf, SEG), 1000.0)


@query(f"WITH RECURSIVE {_MEP}, x AS (SELECT a, b FROM e WHERE d <= 1000 UNION ALL SELECT b, a FROM e WHERE d <= 1000), r AS (SELECT DISTINCT a AS k, a AS m FROM x UNION SELECT r.k, x.b FROM r JOIN x ON r.m = x.a) SELECT k, min(m) AS network FROM r GROUP BY 1", SEG)
def mep_networks(spark, sf):
    return spatial.mep_networks(view(spark, sf, SEG), 1000.0)


@query(
    f"""WITH p AS (SELECT a.k AS opening, b.k AS host, abs(a.cy - b.cy) AS v FROM segments_v a JOIN segments_v b ON a.shape = 'void' AND b.shape = 'plane_vertical' AND {_GAP.format("z")} <= 200 AND a.cx >= b.min_x - 200 AND a.cx <= b.max_x + 200 AND abs(a.cy - b.cy) <= (b.max_y - b.min_y) / 2 + 200)
SELECT opening, arg_min(host, (v, host)) AS host, round_even(min(v), 3) AS across_mm FROM p GROUP BY 1""",
    SEG,
)
def opening_hosts(spark, sf):
    df = view(spark, sf, SEG)
    return spatial.openings(df.filter("shape = 'plane_vertical'"), df.filter("shape = 'void'"))


_ALLMEP = _SET([*spatial.CARRIERS, *spatial.INLINE, "pump", "tank"])
_NEAR = " AND ".join(f"{_GAP.format(a)} <= 250" for a in "xyz")


@query(
    f"""WITH {_C}, p AS (SELECT a.k AS a, b.k AS b, a.element_type AS ta, b.element_type AS tb, a.min_z AS za, b.max_z AS zb, {" AND ".join(f"a.c{x} BETWEEN b.min_{x} - 200 AND b.max_{x} + 200" for x in "xyz")} AS inside FROM c a JOIN c b ON a.k <> b.k AND {_NEAR})
SELECT a, b, 'SUPPORTED_BY' AS relation, 0.92::DOUBLE AS confidence FROM p WHERE ta IN ('column', 'wall') AND tb IN ('floor', 'ceiling') AND abs(za - zb) < 250
UNION ALL SELECT a, b, 'HOSTED_BY', 0.95 FROM p WHERE ta IN ('door', 'window') AND tb = 'wall' AND inside
UNION ALL SELECT a, b, 'CONNECTED_TO', 0.88 FROM p WHERE ta IN {_ALLMEP} AND tb IN {_ALLMEP}
UNION ALL SELECT a, b, 'INTERSECTS', 0.90 FROM p WHERE ta = 'wall' AND tb = 'floor' AND za <= zb + 100""",
    SEG,
)
def topology_relations(spark, sf):
    return spatial.topology(_classified(spark, sf))


@query("SELECT k, CASE WHEN o IS NOT NULL THEN level END AS level, round_even(o, 3) AS overlap_mm FROM (SELECT s.k, arg_max(l.level, (least(max_z, l.top) - greatest(min_z, l.base), -l.level)) AS level, max(least(max_z, l.top) - greatest(min_z, l.base)) AS o FROM segments_v s LEFT JOIN (SELECT i AS level, i * 3000.0 AS base, (i + 1) * 3000.0 AS top FROM range(4) t(i)) l ON max_z > l.base AND min_z < l.top GROUP BY 1) q", SEG)
def storey_assignment(spark, sf):
    levels = spark.range(4).select(F.col("id").alias("level"), (F.col("id") * 3000.0).alias("base"), ((F.col("id") + 1) * 3000.0).alias("top"))
    return spatial.storeys_of(view(spark, sf, SEG), levels)


# Points ------------------------------------------------------------------------------------------------------------

_CELL = "CAST(floor({0} / {1}) AS BIGINT)"


@query("SELECT CAST(floor(x / 0.5) AS BIGINT) AS vx, CAST(floor(y / 0.5) AS BIGINT) AS vy, CAST(floor(z / 0.5) AS BIGINT) AS vz, count(*) AS n, round_even(avg(x), 6) AS mean_x, round_even(avg(y), 6) AS mean_y, round_even(avg(z), 6) AS mean_z FROM points_v GROUP BY 1, 2, 3", PTS)
def voxel_downsample(spark, sf):
    return points.voxels(view(spark, sf, PTS))


@query("SELECT point_id, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY floor(x / 0.5), floor(y / 0.5), floor(z / 0.5) ORDER BY point_id) AS r FROM points_v) q WHERE r = 1", PTS)
def voxel_first_point(spark, sf):
    return points.first_points(view(spark, sf, PTS))


@query("SELECT xor(xor(CAST(floor(x / 2) AS BIGINT) << 40, CAST(floor(y / 2) AS BIGINT) << 20), CAST(floor(z / 2) AS BIGINT)) AS block, count(*) AS n, min(point_id) AS first_point FROM points_v GROUP BY 1", PTS)
def block_index(spark, sf):
    return points.blocks(view(spark, sf, PTS))


@query("SELECT point_id, x, y, z FROM points_v WHERE x BETWEEN 1 - 0.15 AND 4 + 0.15 AND y BETWEEN 1 - 0.15 AND 4 + 0.15 AND z BETWEEN 0 - 0.15 AND 3 + 0.15 AND point_id % 2 = 0", PTS)
def box_query(spark, sf):
    return points.in_box(view(spark, sf, PTS), (1, 1, 0), (4, 4, 3), stride=2).select("point_id", "x", "y", "z")


@query("SELECT point_id, x, y FROM points_v WHERE z BETWEEN 1.2 - 0.25 / 2 AND 1.2 + 0.25 / 2", PTS)
def z_slab(spark, sf):
    return points.slab(view(spark, sf, PTS), 1.2, 0.25)


@query("SELECT CAST(floor(z / 0.08) AS BIGINT) AS bin, count(*) AS n FROM points_v GROUP BY 1", PTS)
def height_profile(spark, sf):
    return points.profile(view(spark, sf, PTS))


@query("SELECT CAST(floor(x / 0.3) AS BIGINT) AS gx, CAST(floor(y / 0.3) AS BIGINT) AS gy, count(*) AS n, round_even(max(z) - min(z), 6) AS span FROM points_v GROUP BY 1, 2 HAVING count(*) >= 10 AND round_even(max(z) - min(z), 6) >= 3", PTS)
def column_cells(spark, sf):
    return points.column_cells(view(spark, sf, PTS), least_points=10)


@query("SELECT surface, count(*) AS n, " + ", ".join(f"round_even(quantile_cont({c}, 0.05), 6) AS p5_{c}, round_even(quantile_cont({c}, 0.95), 6) AS p95_{c}" for c in "xyz") + " FROM points_v GROUP BY 1", PTS)
def robust_extents(spark, sf):
    return points.robust_extents(view(spark, sf, PTS))


@query("SELECT surface, " + ", ".join(f"round_even(covar_samp({a}, {b}), 4) AS c{a}{b}" for i, a in enumerate("xyz") for b in "xyz"[i:]) + " FROM points_v GROUP BY 1", PTS)
def covariance_features(spark, sf):
    return points.covariances(view(spark, sf, PTS))


@query("SELECT surface, round_even(sqrt(avg(e * e)) * 1000, 4) AS sigma_mm FROM (SELECT surface, CASE surface WHEN 0 THEN y - 0.002 WHEN 1 THEN y - 6.002 WHEN 2 THEN x - 0.002 WHEN 3 THEN x - 8.002 END AS e FROM points_v) q WHERE e IS NOT NULL GROUP BY 1", PTS)
def plane_sigma(spark, sf):
    return points.plane_sigma(view(spark, sf, PTS), "surface", {0: (0, 1, 0, -0.002), 1: (0, 1, 0, -6.002), 2: (1, 0, 0, -0.002), 3: (1, 0, 0, -8.002)})


@query("SELECT round_even(d, 6) AS diagonal, unit, CASE WHEN d BETWEEN lo AND hi THEN s ELSE 0 END::DOUBLE AS score FROM (SELECT sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2 + (max(z) - min(z)) ** 2) AS d FROM points_v) p, (VALUES ('m', 1.0, 2000.0, 0.75), ('mm', 1000.0, 2000000.0, 0.5), ('ft', 3.0, 6500.0, 0.6)) u(unit, lo, hi, s)", PTS)
def unit_resolution(spark, sf):
    return points.unit_scores(view(spark, sf, PTS))


@query("SELECT chunk_x, chunk_y, count(*) AS n FROM (SELECT unnest(generate_series(CAST(floor((x - 0.25) / 2) AS BIGINT), CAST(floor((x + 0.25) / 2) AS BIGINT))) AS chunk_x, y FROM points_v) a, LATERAL (SELECT unnest(generate_series(CAST(floor((y - 0.25) / 2) AS BIGINT), CAST(floor((y + 0.25) / 2) AS BIGINT))) AS chunk_y) b GROUP BY 1, 2", PTS)
def overlapping_chunks(spark, sf):
    return points.chunks(view(spark, sf, PTS)).groupBy("chunk_x", "chunk_y").agg(F.count("*").alias("n"))


@query()
def statistical_outliers(spark, sf):
    return points.outliers(view(spark, sf, PTS))


@query("SELECT zone_id, round_even(points / area_m2, 4) AS density, round_even(noise / points, 4) AS noise_ratio, concat_ws(',', CASE WHEN points < 1000 THEN 'too_few_points' END, CASE WHEN points / area_m2 < 100 THEN 'low_density' END) AS errors, concat_ws(',', CASE WHEN noise / points > 0.1 THEN 'noisy' END, CASE WHEN area_m2 < 1 THEN 'small_area' END) AS warnings, points >= 1000 AND points / area_m2 >= 100 AS passed FROM (SELECT zone_id, sum(point_count) AS points, sum((max_x - min_x) * (max_y - min_y)) / 1e6 AS area_m2, sum(CASE WHEN shape = 'valve_candidate' THEN point_count ELSE 0 END) AS noise FROM segments_v GROUP BY 1) q", SEG)
def scan_quality_gate(spark, sf):
    scans = view(spark, sf, SEG).groupBy("zone_id").agg(F.sum("point_count").alias("points"), (F.sum(E.extent("x") * E.extent("y")) / 1e6).alias("area_m2"), F.sum(F.when(F.col("shape") == "valve_candidate", F.col("point_count")).otherwise(0)).alias("noise"))
    return quality.scan_gate(scans)


# Quality -----------------------------------------------------------------------------------------------------------

_L = f"l AS (SELECT segment_id, {_LOA.format('sigma_mm')} AS represented FROM (SELECT segment_id, coalesce(CASE WHEN k % 9 = 0 THEN NULL ELSE (k % 40) / 2.0E0 END, 25) AS sigma_mm FROM segments_v) q)"


def _sigmas(spark, sf):
    return view(spark, sf, SEG).select("segment_id", F.when(F.col("k") % 9 != 0, (F.col("k") % 40) / F.lit(2.0)).alias("sigma_mm"))


@query(f"WITH {_L} SELECT segment_id, represented, 'LOA20' AS measured, CASE WHEN represented = 'LOA10' THEN 'LOA10' ELSE 'LOA20' END AS effective FROM l", SEG)
def loa_statements(spark, sf):
    return quality.loa(_sigmas(spark, sf))


@query(f"WITH {_L} SELECT tier, count(e) AS n FROM (VALUES ('LOA50'), ('LOA40'), ('LOA30'), ('LOA20'), ('LOA10')) t(tier) LEFT JOIN (SELECT CASE WHEN represented = 'LOA10' THEN 'LOA10' ELSE 'LOA20' END AS e FROM l) x ON e = tier GROUP BY 1", SEG)
def loa_distribution(spark, sf):
    return quality.tier_distribution(quality.loa(_sigmas(spark, sf)))


@query(f"SELECT station_index, source_file, {_RICS.format('rmse_mm', 'inlier_ratio', chr(39) + 'A' + chr(39), chr(39) + 'B' + chr(39), chr(39) + 'C' + chr(39), chr(39) + 'FAIL' + chr(39))} AS category FROM stations_v", STA)
def station_classes(spark, sf):
    return quality.registration(view(spark, sf, STA))


@query(f"SELECT round_even(g, 4) AS global_rmse_mm, round_even(r, 4) AS mean_ratio, (['A', 'B', 'C', 'FAIL'])[greatest(w, {_RICS.format('g', 'r', 0, 1, 2, 3)}) + 1] AS overall FROM (SELECT sqrt(avg(CASE WHEN station_index > 0 THEN rmse_mm * rmse_mm END)) AS g, avg(inlier_ratio) AS r, max({_RICS.format('rmse_mm', 'inlier_ratio', 0, 1, 2, 3)}) AS w FROM stations_v) q", STA)
def registration_quality(spark, sf):
    return quality.registration_overall(view(spark, sf, STA))


_CHK = "k AS (SELECT segment_id, round_even(greatest(sqrt(((k % 5) ** 2 + (k % 11) ** 2 + (k % 17) ** 2) / 3.0), (k % 13)::DOUBLE), 2) AS deviation_mm FROM segments_v)"


def _checks(spark, sf):
    s = view(spark, sf, SEG)
    off = {"x": F.col("k") % 5, "y": F.col("k") % 11, "z": F.col("k") % 17}
    i = s.withColumns({f"max_{a}": F.col(f"max_{a}") + off[a] for a in "xyz"}).withColumn("cx", F.col("cx") + F.col("k") % 13)
    return quality.deviation_checks(s.select("k", F.struct(*s.columns).alias("s")).join(i.select("k", F.struct(*i.columns).alias("i")), "k"))


@query(f"WITH {_CHK} SELECT segment_id, deviation_mm, deviation_mm <= 10 AS passed FROM k", SEG)
def deviation_checks(spark, sf):
    return _checks(spark, sf)


@query(f"WITH {_CHK} SELECT count(*) AS n, round_even(100.0 * avg((deviation_mm <= 10)::INT), 1) AS pass_rate, max(deviation_mm) AS max_mm, round_even(avg(deviation_mm), 2) AS mean_mm, count(*) FILTER (deviation_mm > 10) AS n_failed FROM k", SEG)
def deviation_summary(spark, sf):
    return quality.deviation_summary(_checks(spark, sf))


@query("SELECT tier, count(*) AS n, max(rpn) AS max_rpn, count(*) FILTER (tests = 0) AS untested FROM (SELECT rpn, tests, CASE WHEN rpn >= 200 THEN 'HIGH' WHEN rpn >= 100 THEN 'MEDIUM' WHEN rpn >= 50 THEN 'LOW' ELSE 'MINIMAL' END AS tier FROM (SELECT (1 + k % 10) * (1 + k % 7) * (1 + k % 5) AS rpn, k % 3 AS tests FROM segments_v) q) q GROUP BY 1", SEG)
def fmea_summary(spark, sf):
    return quality.fmea_summary(view(spark, sf, SEG).select((1 + F.col("k") % 10).alias("severity"), (1 + F.col("k") % 7).alias("likelihood"), (1 + F.col("k") % 5).alias("detection"), (F.col("k") % 3).alias("tests")))


_HAND = f"""{_C}, a(element_type, attribute) AS (VALUES {rules_sql.WANTED}),
r AS (SELECT upper(substr(c.element_type, 1, 2)) || '-' || right(segment_id, 6) AS tag, c.element_type, attribute, CASE attribute WHEN 'diameter' THEN round_even((min_e + mid_e) / 2, 1) WHEN 'length' THEN round_even(max_e, 1) WHEN 'volume' THEN round_even(w * d * h / 1e9, 6) END AS value FROM c JOIN a USING (element_type))"""


@query(f"WITH {_HAND} SELECT tag, element_type, attribute, value, CASE WHEN value IS NULL THEN 'PENDING' ELSE 'POPULATED' END AS status FROM r", SEG)
def handover_attributes(spark, sf):
    return quality.handover(_classified(spark, sf))


@query(f"WITH {_HAND} SELECT element_type, count(*) AS asked, count(value) AS populated, round_even(100.0 * count(value) / count(*), 1) AS pct FROM r GROUP BY 1", SEG)
def handover_coverage(spark, sf):
    return quality.coverage(handover_attributes(spark, sf))


# Ledger ------------------------------------------------------------------------------------------------------------

_GATE = f"{_C}, g AS (SELECT *, CASE safety_category WHEN 'SC1' THEN 'blocked' WHEN 'SC2' THEN 'pending' ELSE 'passed' END AS gate FROM c)"


@query(f"WITH {_GATE} SELECT segment_id, element_type, safety_category, gate FROM g", SEG)
def safety_gates(spark, sf):
    return ledger.gates(_classified(spark, sf)).select("segment_id", "element_type", "safety_category", "gate")


@query(f"WITH {_GATE} SELECT zone_id, count(*) FILTER (gate = 'passed') AS created, count(*) FILTER (gate = 'blocked') AS blocked, count(*) FILTER (gate = 'pending') AS pending, count(*) FILTER (gate = 'passed' AND confidence < 0.6) AS ncr_minor, count(*) FILTER (gate <> 'passed') = 0 AS completed FROM g GROUP BY 1", SEG)
def execution_summary(spark, sf):
    return ledger.execution(_classified(spark, sf))


@query("SELECT event_type, count(*) AS n, count(DISTINCT session_id) AS sessions, min(ts) AS first_ts, max(ts) AS last_ts FROM audit_v GROUP BY 1", AUD)
def audit_stats(spark, sf):
    return ledger.stats(view(spark, sf, AUD))


@query("SELECT session_id, arg_max(state, (ts, event_id)) AS state, count(*) AS steps FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 'OPEN' WHEN 'click' THEN 'RESOLVED' WHEN 'view' THEN 'CLOSED' END AS state FROM audit_v) q WHERE state IS NOT NULL GROUP BY 1", AUD)
def ncr_states(spark, sf):
    return ledger.last_state(view(spark, sf, AUD))


@query("SELECT session_id, CASE WHEN p = 0 AND o = 0 AND g = 0 THEN 'PUBLISHED' WHEN p = 0 THEN 'SHARED' ELSE 'WIP' END AS may_be FROM (SELECT session_id, count(*) FILTER (event_type = 'signup') AS p, count(*) FILTER (event_type = 'purchase') AS o, count(*) FILTER (value > 99) AS g FROM audit_v GROUP BY 1) q", AUD)
def release_states(spark, sf):
    s = view(spark, sf, AUD).groupBy("session_id").agg(F.count_if(F.col("event_type") == "signup").alias("pending"), F.count_if(F.col("event_type") == "purchase").alias("open_ncr"), F.count_if(F.col("value") > 99).alias("pending_gates"), F.lit(True).alias("chain_ok"))
    return ledger.release(s)


SECRET = b"plumbline"


@query()
def audit_chain(spark, sf):
    return ledger.chained(view(spark, sf, AUD), SECRET)


@query(
    """WITH o AS (SELECT session_id, event_id, event_id % 50 = 0 AS bad, lag(event_id % 50 = 0) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS after FROM audit_v)
SELECT session_id, event_id, CASE WHEN bad THEN 'hash_mismatch' ELSE 'chain_break' END AS reason FROM o WHERE bad OR after""",
    AUD,
)
def audit_chain_faults(spark, sf):
    """A ledger in which every fiftieth hash was written over: it doesn't match, and the next event doesn't link to it."""
    chain = ledger.chained(view(spark, sf, AUD), SECRET)
    return ledger.verified(chain.withColumn("event_hash", F.when(F.col("event_id") % 50 == 0, F.lit("0" * 64)).otherwise(F.col("event_hash"))), SECRET)


# Metrics -----------------------------------------------------------------------------------------------------------

_K = "k AS (SELECT label, (SELECT count(*) FROM labels_v WHERE y_true = label) AS support, (SELECT count(*) FROM labels_v WHERE y_pred = label) AS predicted, (SELECT count(*) FROM labels_v WHERE y_true = label AND y_pred = label) AS tp FROM (SELECT y_true AS label FROM labels_v UNION SELECT y_pred FROM labels_v) u)"
_KM = f"{_K}, m AS (SELECT label, support, predicted, tp, round_even(coalesce(tp / nullif(predicted, 0), 0), 4) AS precision, round_even(coalesce(tp / nullif(support, 0), 0), 4) AS recall, round_even(coalesce(2 * tp / nullif(support + predicted, 0), 0), 4) AS f1, round_even(coalesce(tp / nullif(support + predicted - tp, 0), 0), 4) AS iou FROM k)"


@query("SELECT y_true, y_pred, count(*) AS n FROM labels_v GROUP BY 1, 2", LAB)
def confusion_matrix(spark, sf):
    return metrics.confusion(view(spark, sf, LAB))


@query(f"WITH {_KM} SELECT * FROM m", LAB)
def class_metrics(spark, sf):
    return metrics.class_metrics(view(spark, sf, LAB))


@query(f"WITH {_KM} SELECT round_even(sum(tp) / sum(support), 6) AS accuracy, round_even(avg(f1), 6) AS macro_f1, round_even(avg(iou), 6) AS mean_iou FROM m", LAB)
def overall_metrics(spark, sf):
    return metrics.overall_metrics(view(spark, sf, LAB))


_INST = "t AS (SELECT point_id, surface AS gt FROM points_v), p AS (SELECT point_id, CASE WHEN surface = 4 AND point_id % 4 >= 2 THEN 6 WHEN point_id % 10 = 0 THEN (surface + 1) % 6 ELSE surface END AS pred FROM points_v), i AS (SELECT gt, pred, count(*) AS shared, (SELECT count(*) FROM t t2 WHERE t2.gt = t.gt) AS nt, (SELECT count(*) FROM p p2 WHERE p2.pred = p.pred) AS np FROM t JOIN p USING (point_id) GROUP BY 1, 2), j AS (SELECT gt, pred, shared, round_even(shared / (nt + np - shared), 6) AS iou, nt, np FROM i)"


def _instances(spark, sf):
    p = view(spark, sf, PTS)
    pred = F.when((F.col("surface") == 4) & (F.col("point_id") % 4 >= 2), F.lit(6)).when(F.col("point_id") % 10 == 0, (F.col("surface") + 1) % 6).otherwise(F.col("surface"))
    truth = p.select("point_id", F.col("surface").alias("object_id"))
    return truth, metrics.instance_iou(truth, p.select("point_id", pred.alias("object_id")))


@query(f"WITH {_INST} SELECT * FROM j", PTS)
def instance_iou(spark, sf):
    return _instances(spark, sf)[1]


@query(f"WITH {_INST} SELECT count(*) AS n, count(*) FILTER (good >= 1) AS recalled, count(*) FILTER (good > 1) AS duplicated, count(*) FILTER (parts >= 2) AS fragmented FROM (SELECT gt, count(*) FILTER (iou >= 0.3) AS good, count(*) FILTER (shared >= 0.15 * nt AND shared >= 10) AS parts FROM j GROUP BY 1) q", PTS)
def instance_metrics(spark, sf):
    truth, pairs = _instances(spark, sf)
    return metrics.instance_metrics(pairs, truth)


@query("SELECT point_id, arg_max(label, (p, -label)) AS label, max(p) AS p FROM (SELECT point_id, label, round_even(avg(p), 6) AS p FROM (SELECT point_id, l AS label, ((point_id * (l + 3) + c * 7) % 11) / 10.0E0 AS p FROM points_v, range(3) a(l), range(2) b(c) WHERE (point_id + c) % 3 <> 0) q GROUP BY 1, 2) q GROUP BY 1", PTS)
def chunk_reconciliation(spark, sf):
    v = view(spark, sf, PTS).select("point_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("label")).withColumn("c", F.explode(F.array(F.lit(0), F.lit(1)))).filter((F.col("point_id") + F.col("c")) % 3 != 0)
    return metrics.reconciled(v.withColumn("p", ((F.col("point_id") * (F.col("label") + 3) + F.col("c") * 7) % 11) / F.lit(10.0)))


@query("WITH n AS (SELECT y_true AS label, count(*) AS n FROM labels_v GROUP BY 1) SELECT label, n, round_even(((SELECT sum(n) FROM n) + (SELECT count(*) FROM n)) / ((SELECT count(*) FROM n) * (n + 1)), 6) AS weight FROM n", LAB)
def class_weights(spark, sf):
    return metrics.class_weights(view(spark, sf, LAB))


@query("SELECT query_id, CAST(r - 1 AS BIGINT) AS rank, vec_id, d2 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, vec_id) AS r FROM (SELECT q.vec_id AS query_id, v.vec_id, round_even(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: (x[1] - x[2])::DOUBLE * (x[1] - x[2])::DOUBLE)), 4) AS d2 FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id) p) p WHERE r <= 3")
def nearest_vectors(spark, sf):
    return vectors.nearest_vectors(view(spark, sf, "embeddings"))


# Windows over events -----------------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round_even(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def hourly_events(spark, sf):
    e = view(spark, sf, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.bround(F.sum("value"), 4).alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY user_id, i")
def event_sessions(spark, sf):
    e = view(spark, sf, "events")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


# Walls, merges, clusters -------------------------------------------------------------------------------------------

_AX = "(max_x - min_x >= max_y - min_y)"
_V = f"v AS (SELECT *, {_AX} AS ax FROM segments_v WHERE shape = 'plane_vertical')"
_ACROSS = "CASE WHEN a.ax THEN abs(a.cy - b.cy) ELSE abs(a.cx - b.cx) END"
_ALONG = f"CASE WHEN a.ax THEN {_GAP.format('x')} ELSE {_GAP.format('y')} END"
_HMIN = "least(a.max_z - a.min_z, b.max_z - b.min_z)"


@query(
    f"""WITH RECURSIVE {_V}, e AS (SELECT a.k AS a, b.k AS b FROM v a JOIN v b ON a.k < b.k AND a.ax = b.ax AND {_ACROSS} <= 400 AND {_ALONG} <= 1200 AND (-({_GAP.format("z")}) >= 0.3 * {_HMIN} OR -({_GAP.format("z")}) >= 250) AND {" AND ".join(f"{_GAP.format(x)} <= 1200" for x in "xyz")}),
x AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT k, k AS m FROM v UNION SELECT r.k, x.b FROM r JOIN x ON r.m = x.a), w AS (SELECT k, min(m) AS wall FROM r GROUP BY 1)
SELECT wall, count(*) AS fragments, min(min_x) AS min_x, min(min_y) AS min_y, min(min_z) AS min_z, max(max_x) AS max_x, max(max_y) AS max_y, max(max_z) AS max_z, sum(point_count)::BIGINT AS points, max(confidence) AS confidence FROM w JOIN v USING (k) GROUP BY 1""",
    SEG,
)
def wall_groups(spark, sf):
    return walls.wall_groups(view(spark, sf, SEG), offset_mm=400.0)


@query(f"WITH {_V}, p AS (SELECT a.k AS a, b.k AS b, {_ACROSS} AS d FROM v a JOIN v b ON a.k < b.k AND a.ax = b.ax AND {_ALONG} < 0 AND -({_GAP.format('z')}) >= 0.25 * {_HMIN} AND {_GAP.format('z')} <= 450 AND {_GAP.format('x')} <= 450 AND {_GAP.format('y')} <= 450) SELECT a, b, d AS distance_mm, greatest(100, least(600, d)) AS thickness_mm FROM p WHERE d BETWEEN 50 AND 450", SEG)
def opposing_faces(spark, sf):
    return walls.face_candidates(view(spark, sf, SEG))


_I6, _C6 = f"({_INT}) / ({_VOL.format('a')} + {_VOL.format('b')} - ({_INT}))", f"({_INT}) / least({_VOL.format('a')}, {_VOL.format('b')})"
_GX, _GY, _GZ = (_GAP.format(x) for x in "xyz")
_SIDE = f"((-({_GX}) > 300 AND {_GY} <= 120) OR (-({_GY}) > 300 AND {_GX} <= 120))"


@query(
    f"""WITH RECURSIVE s AS (SELECT * FROM segments_v WHERE shape IN ('void', 'valve_candidate') OR point_count >= 1),
e AS (SELECT a.k AS a, b.k AS b FROM s a JOIN s b ON a.k < b.k AND a.shape = b.shape AND a.shape LIKE 'plane%' AND abs(a.cz - b.cz) < CASE WHEN a.shape = 'plane_sloped' THEN 300 ELSE 150 END AND {_GX} <= 0 AND {_GY} <= 0 AND {_GZ} <= 0
 AND ({_I6} >= 0.65 OR {_C6} >= 0.9 OR (a.shape = 'plane_vertical' AND -({_GZ}) > 300 AND {_SIDE}) OR (a.shape <> 'plane_vertical' AND {_GZ} <= 80 AND {_SIDE}))),
x AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT k, k AS m FROM s UNION SELECT r.k, x.b FROM r JOIN x ON r.m = x.a), w AS (SELECT k, min(m) AS merged FROM r GROUP BY 1)
SELECT merged, shape, count(*) AS parts, min(min_x) AS min_x, min(min_y) AS min_y, min(min_z) AS min_z, max(max_x) AS max_x, max(max_y) AS max_y, max(max_z) AS max_z, sum(point_count)::BIGINT AS point_count, max(confidence) AS confidence FROM w JOIN s USING (k) GROUP BY 1, 2""",
    SEG,
)
def segment_merge(spark, sf):
    return clusters.merged(view(spark, sf, SEG))


@query()
def overlap_suppression(spark, sf):
    return clusters.suppressed(view(spark, sf, SEG))


@query()
def storey_levels(spark, sf):
    found = walls.levels(view(spark, sf, SEG))
    return spark.createDataFrame([(z,) for z in found], "level_mm double")


@query()
def point_storeys(spark, sf):
    return spark.createDataFrame([(z,) for z in points.storeys(view(spark, sf, PTS))], "height double")


@query(
    """WITH RECURSIVE p AS (SELECT * FROM points_v WHERE surface = 5), e AS (SELECT a.point_id AS a, b.point_id AS b FROM p a JOIN p b ON a.point_id < b.point_id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 0.25),
x AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT point_id AS k, point_id AS m FROM p UNION SELECT r.k, x.b FROM r JOIN x ON r.m = x.a) SELECT k AS point_id, min(m) AS cluster FROM r GROUP BY 1""",
    PTS,
)
def euclidean_clusters(spark, sf):
    return clusters.euclidean(view(spark, sf, PTS).filter("surface = 5"), 0.25)


@query()
def dbscan_clusters(spark, sf):
    return clusters.dbscan(view(spark, sf, PTS), 0.6, 8)


@query()
def pca_features(spark, sf):
    return fits.eigen(view(spark, sf, PTS), "surface").select("surface", "n", *[F.bround(c, 4).alias(c) for c in ("nx", "ny", "nz", "linearity", "planarity", "sphericity")])


@query()
def point_normals(spark, sf):
    return fits.normals(view(spark, sf, PTS), 0.5)


@query()
def plane_detection(spark, sf):
    rows = [(i, *p["normal"], p["offset"], p["inliers"]) for i, p in enumerate(fits.planes(view(spark, sf, PTS)))]
    return spark.createDataFrame(rows, "plane long, nx double, ny double, nz double, offset double, inliers long")


@query()
def floor_plan_lines(spark, sf):
    rows = [(i, *p["normal"], p["offset"], p["inliers"]) for i, p in enumerate(fits.lines(points.in_box(view(spark, sf, PTS), (-1, -1, 1.0), (9, 7, 2.0), 0.0)))]
    return spark.createDataFrame(rows, "line long, nx double, ny double, offset double, inliers long")


@query()
def bounding_rectangles(spark, sf):
    return fits.rectangles(view(spark, sf, PTS), "surface")


@query()
def wall_thickness(spark, sf):
    return fits.thickness(view(spark, sf, PTS).filter("surface IN (0, 1)"), "surface", "y")


@query("SELECT segment_id, zone_id, shape, point_count FROM (SELECT concat('syn-', lpad(concat('', id), 8, '0')) AS segment_id, concat('Z', id % 5) AS zone_id, CASE id % 4 WHEN 0 THEN 'plane_vertical' WHEN 1 THEN 'plane_horizontal' WHEN 2 THEN 'cylinder' ELSE 'box' END AS shape, 50 + (id * 7919) % 1000 AS point_count FROM range(1000) t(id)) q")
def synthetic_segments(spark, sf, n: int = 1000):
    """A generated scene of any size: every value is a function of the row's number."""
    i = F.col("id")
    shape = F.element_at(F.array(*map(F.lit, ("plane_vertical", "plane_horizontal", "cylinder", "box"))), (i % 4 + 1).cast("int"))
    return spark.range(n).select(F.concat(F.lit("syn-"), F.lpad(i.cast("string"), 8, "0")).alias("segment_id"), F.concat(F.lit("Z"), (i % 5).cast("string")).alias("zone_id"), shape.alias("shape"), (50 + (i * 7919) % 1000).alias("point_count"))


@query()
def step_export(spark, sf):
    return tables.step_lines(_classified(spark, sf))


@query()
def floor_plan_svg(spark, sf):
    return tables.svg_shapes(view(spark, sf, SEG))


# Semantics and services --------------------------------------------------------------------------------------------

_RGB = "rgb AS (SELECT *, ((point_id * 37) % 256)::DOUBLE AS r, CASE WHEN point_id % 3 = 0 THEN (point_id * 37) % 256 ELSE (point_id * 11) % 256 END::DOUBLE AS g, CASE WHEN point_id % 3 = 0 THEN (point_id * 37) % 256 ELSE (surface * 40) END::DOUBLE AS b FROM points_v)"


def _coloured(spark, sf):
    i = F.col("point_id")
    r = (i * 37) % 256
    return view(spark, sf, PTS).withColumns({"r": r.cast("double"), "g": F.when(i % 3 == 0, r).otherwise((i * 11) % 256).cast("double"), "b": F.when(i % 3 == 0, r).otherwise(F.col("surface") * 40).cast("double")})


@query(f"WITH {_RGB} SELECT surface, count(*) AS n, '#' || " + " || ".join(f"lpad(to_hex(round_even(avg({c}), 0)::BIGINT), 2, '0')" for c in "rgb") + " AS colour, round_even((var_pop(r) + var_pop(g) + var_pop(b)) / 3, 4) AS variance FROM rgb GROUP BY 1", PTS)
def dominant_colours(spark, sf):
    return semantics.dominant_colours(_coloured(spark, sf), "surface")


@query(
    f"""WITH {_RGB}, q AS (SELECT CASE WHEN coalesce((greatest(r, g, b) - least(r, g, b)) / nullif(greatest(r, g, b), 0), 0) > 0.05 THEN concat_ws('-', floor(r / 32)::BIGINT, floor(g / 32)::BIGINT, floor(b / 32)::BIGINT) END AS bucket, count(*) AS n FROM rgb GROUP BY 1),
k AS (SELECT *, sum(CASE WHEN bucket IS NOT NULL THEN n END) OVER () AS total, row_number() OVER (PARTITION BY bucket IS NULL ORDER BY n DESC, bucket) AS rank FROM q)
SELECT CASE WHEN bucket IS NULL THEN 'grey' WHEN rank <= 12 AND (n >= 120 OR n >= 0.01 * total) THEN bucket ELSE 'misc' END AS grp, sum(n)::BIGINT AS n FROM k GROUP BY 1""",
    PTS,
)
def colour_groups(spark, sf):
    return semantics.colour_groups(_coloured(spark, sf))


_TAX = rules_sql.TAXONOMY


@query(f"SELECT segment_id, shape, {_TAX} AS canonical FROM segments_v", SEG)
def taxonomy_mapping(spark, sf):
    return semantics.mapped(view(spark, sf, SEG).select("segment_id", "shape"), "scan", "shape")


@query("SELECT segment_id, round_even(s, 6) AS support, round_even(0.35 * confidence + 0.30 * s + 0.20 * ((k % 10) / 10.0E0) + 0.15 * 0.5, 6) AS confidence FROM (SELECT *, 0.4 * least(1.0, point_count / 50.0E0) + 0.4 * greatest(0.0, 1 - ((k % 8) / 100.0E0) / 0.05) + 0.2 * least(1.0, (max_x - min_x) * (max_y - min_y) / 1e6 / 0.5) AS s FROM segments_v) q", SEG)
def fused_confidence(spark, sf):
    rows = view(spark, sf, SEG).select("segment_id", F.col("confidence").alias("geometry"), F.col("point_count").alias("points"), ((F.col("k") % 8) / 100).alias("rmse_m"), (E.extent("x") * E.extent("y") / 1e6).alias("area_m2"), ((F.col("k") % 10) / 10).alias("semantic"), F.lit(0.5).alias("context"))
    return semantics.fused(rows).select("segment_id", "support", "confidence")


@query("SELECT point_id, CASE WHEN nz <= 0.35 THEN 'WALL' WHEN nz >= 0.7 AND (z - lo) / (hi - lo) < 0.4 THEN 'FLOOR' WHEN nz >= 0.7 THEN 'CEILING' ELSE 'UNKNOWN' END AS label FROM (SELECT *, CASE WHEN surface < 4 THEN 0 WHEN surface = 4 THEN 1 ELSE 0.5 END AS nz, min(z) OVER () AS lo, max(z) OVER () AS hi FROM points_v) q", PTS)
def point_semantics(spark, sf):
    return semantics.point_classes(view(spark, sf, PTS).withColumn("nz", F.when(F.col("surface") < 4, 0.0).when(F.col("surface") == 4, 1.0).otherwise(0.5)))


@query()
def topology_reinforcement(spark, sf):
    # All elements of a class have the same relations, so classes are summed up and spread to their members.
    found, members = spatial.class_topology(_classified(spark, sf))
    boost = semantics.reinforced(found).withColumnRenamed("a", "class")
    return spatial.met(members, boost, "class").select(F.col("member").alias("a"), "relations", "boost")


@query("SELECT segment_id, substr(sha256(concat_ws('|', zone_id, shape, " + ", ".join(f"format('{{:.1f}}', {c})" for c in ("cx", "cy", "cz", "min_x", "min_y", "min_z", "max_x", "max_y", "max_z")) + ")), 1, 32) AS content_id FROM segments_v", SEG)
def content_ids(spark, sf):
    return semantics.identity(view(spark, sf, SEG))


@query("SELECT zone_id, count(*) AS n, CAST(sum(CAST(('0x' || substr(sha256(segment_id), 1, 15))::BIGINT AS DECIMAL(38,0))) AS VARCHAR) AS hash FROM segments_v GROUP BY 1", SEG)
def output_hashes(spark, sf):
    return semantics.output_hash(view(spark, sf, SEG), "zone_id", "segment_id")


@query(f"WITH {_C}, p AS (SELECT t.k, c2.k AS carrier, sqrt((t.cx - c2.cx) ** 2 + (t.cy - c2.cy) ** 2 + (t.cz - c2.cz) ** 2) AS d FROM c t JOIN c c2 ON t.element_type IN ('sprinkler', 'valve', 'smoke_detector', 'strainer', 'expansion_joint') AND c2.element_type IN {_SET(spatial.CARRIERS)}) SELECT k, arg_min(carrier, (d, carrier)) AS carrier, round_even(min(d), 3) AS distance_mm FROM p WHERE d <= 1500 GROUP BY 1", SEG)
def terminal_carriers(spark, sf):
    return mep.terminals(_classified(spark, sf))


@query(
    f"""WITH RECURSIVE c AS (SELECT *, (max_x - min_x) / 2 AS radius FROM segments_v WHERE shape = 'cylinder'),
e AS (SELECT a.k AS a, b.k AS b FROM c a JOIN c b ON a.k < b.k AND abs(a.radius - b.radius) <= 0.2 * greatest(a.radius, b.radius) AND sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) <= greatest(a.radius, b.radius) AND {_GZ} <= 1000),
x AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT k, k AS m FROM c UNION SELECT r.k, x.b FROM r JOIN x ON r.m = x.a), w AS (SELECT k, min(m) AS chain FROM r GROUP BY 1)
SELECT chain, count(*) AS parts, min(min_z) AS min_z, max(max_z) AS max_z, round_even(avg(radius), 4) AS radius FROM w JOIN c USING (k) GROUP BY 1""",
    SEG,
)
def cylinder_chains(spark, sf):
    return mep.cylinder_chains(view(spark, sf, SEG))


_JN = " AND ".join(f"{_GAP.format(x)} <= 400" for x in "xyz")


_TURNED = "sv AS (SELECT * REPLACE (CASE WHEN k % 14 = 0 THEN min_x + max_y - min_y ELSE max_x END AS max_x, CASE WHEN k % 14 = 0 THEN min_y + max_x - min_x ELSE max_y END AS max_y, CASE WHEN k % 14 = 0 THEN min_x + (max_y - min_y) / 2 ELSE cx END AS cx, CASE WHEN k % 14 = 0 THEN min_y + (max_x - min_x) / 2 ELSE cy END AS cy) FROM segments_v WHERE shape = 'plane_vertical'), tv AS (SELECT *, max_x - min_x >= max_y - min_y AS ax FROM sv)"


@query(f"WITH {_TURNED} SELECT a.k AS a, b.k AS b, CASE WHEN (b.cx > a.min_x + 400 AND b.cx < a.max_x - 400) OR (a.cy > b.min_y + 400 AND a.cy < b.max_y - 400) THEN 'T' ELSE 'L' END AS kind FROM tv a JOIN tv b ON a.ax AND NOT b.ax AND {_JN}", SEG)
def wall_junctions(spark, sf):
    """Every second wall is turned, as those of the view all run along x."""
    turn = F.col("k") % 14 == 0
    walls_ = view(spark, sf, SEG).withColumns({"dx": E.extent("x"), "dy": E.extent("y")})
    box = {"max_x": F.when(turn, F.col("min_x") + F.col("dy")).otherwise(F.col("max_x")), "max_y": F.when(turn, F.col("min_y") + F.col("dx")).otherwise(F.col("max_y"))}
    return mep.junctions(walls_.withColumns(box).withColumns({f"c{a}": F.when(turn, (F.col(f"min_{a}") + F.col(f"max_{a}")) / 2).otherwise(F.col(f"c{a}")) for a in "xy"}).drop("dx", "dy"))


@query(f"SELECT k, arg_min(host, (v, host)) AS host FROM (SELECT a.k, b.k AS host, {_VOL.format('b')} AS v FROM segments_v a JOIN segments_v b ON a.k <> b.k AND a.shape IN ('valve_candidate', 'cylinder') AND b.shape IN ('plane_vertical', 'plane_horizontal') AND " + " AND ".join(f"a.c{x} BETWEEN b.min_{x} - 100 AND b.max_{x} + 100" for x in "xyz") + ") q GROUP BY 1", SEG)
def detail_hosts(spark, sf):
    df = view(spark, sf, SEG)
    return mep.hosted(df.filter(F.col("shape").isin("valve_candidate", "cylinder")), df.filter(F.col("shape").isin("plane_vertical", "plane_horizontal")))


@query("SELECT k, arg_min(h, (abs(min_z - h), h))::DOUBLE AS storey_mm FROM segments_v, (VALUES (0.0), (3000.0), (6000.0), (9000.0)) t(h) GROUP BY 1", SEG)
def nearest_storey(spark, sf):
    return mep.nearest_storey(view(spark, sf, SEG), [0, 3000, 6000, 9000])


@query(
    f"""WITH w AS (SELECT *, round_even(cz / 3000.0, 0) AS st FROM segments_v WHERE shape = 'plane_vertical' AND greatest(max_x - min_x, max_y - min_y) >= 800), o AS (SELECT *, round_even(cz / 3000.0, 0) AS st FROM segments_v WHERE shape <> 'plane_vertical'),
p AS (SELECT a.k, b.k AS wall, greatest({_GX}, {_GY}) AS g, CASE WHEN a.cy BETWEEN b.min_y - 500 AND b.max_y + 500 AND b.cx < a.cx AND b.max_x <= a.min_x THEN 'W' WHEN a.cy BETWEEN b.min_y - 500 AND b.max_y + 500 AND b.min_x >= a.max_x THEN 'E' WHEN a.cx BETWEEN b.min_x - 500 AND b.max_x + 500 AND b.max_y <= a.min_y THEN 'S' WHEN a.cx BETWEEN b.min_x - 500 AND b.max_x + 500 AND b.min_y >= a.max_y THEN 'N' END AS side FROM o a JOIN w b ON abs(a.st - b.st) <= 1 AND {_GX} <= 6000 AND {_GY} <= 6000),
m AS (SELECT k, side, arg_min(wall, (g, wall)) AS wall FROM p WHERE side IS NOT NULL GROUP BY 1, 2)
SELECT k, max(wall) FILTER (side = 'W') AS w, max(wall) FILTER (side = 'E') AS e, max(wall) FILTER (side = 'S') AS s, max(wall) FILTER (side = 'N') AS n FROM m GROUP BY 1 HAVING count(*) = 4""",
    SEG,
)
def enclosed_zones(spark, sf):
    return mep.enclosed(view(spark, sf, SEG))


@query(f"WITH {_GATE} SELECT discipline, count(*) FILTER (gate = 'passed') AS created, count(*) FILTER (gate = 'blocked') AS blocked, count(*) FILTER (gate = 'pending') AS pending FROM g GROUP BY 1", SEG)
def discipline_status(spark, sf):
    g = ledger.gates(_classified(spark, sf))
    return g.groupBy("discipline").agg(*[F.count_if(F.col("gate") == s).alias(n) for s, n in (("passed", "created"), ("blocked", "blocked"), ("pending", "pending"))])


@query("SELECT session_id, event_id, ts, event_type FROM audit_v WHERE session_id = 7", AUD)
def session_events(spark, sf):
    return ledger.by_session(view(spark, sf, AUD), 7).select("session_id", "event_id", "ts", "event_type")


@query("SELECT segment_id, CASE WHEN shape IN ('plane_vertical', 'plane_horizontal') THEN greatest(least(max_x - min_x, max_y - min_y), 200.0) ELSE max_x - min_x END AS thickness_mm, greatest(max_z - min_z, 10.0) AS height_mm FROM segments_v", SEG)
def solid_dimensions(spark, sf):
    df = view(spark, sf, SEG)
    flat = F.col("shape").isin("plane_vertical", "plane_horizontal")
    return df.select("segment_id", F.when(flat, F.greatest(F.least(E.extent("x"), E.extent("y")), F.lit(200.0))).otherwise(E.extent("x")).alias("thickness_mm"), F.greatest(E.extent("z"), F.lit(10.0)).alias("height_mm"))


@query("SELECT surface, round_even(sqrt(avg(least(x - x0, x1 - x, y - y0, y1 - y, z - z0, z1 - z) ** 2)) * 1000, 4) AS sigma_mm FROM points_v JOIN (SELECT surface, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM points_v GROUP BY 1) m USING (surface) GROUP BY 1", PTS)
def box_sigma(spark, sf):
    p = view(spark, sf, PTS)
    m = p.groupBy("surface").agg(*[f(c).alias(f"{c}{i}") for c in "xyz" for i, f in ((0, F.min), (1, F.max))])
    d = F.least(*[x for c in "xyz" for x in (F.col(c) - F.col(f"{c}0"), F.col(f"{c}1") - F.col(c))])
    return p.join(m, "surface").groupBy("surface").agg(F.bround(F.sqrt(F.avg(d * d)) * 1000, 4).alias("sigma_mm"))


@query("SELECT segment_id, round_even(a, 4) AS angle FROM (SELECT segment_id, CASE WHEN degrees(atan2(y, x)) < 0 THEN degrees(atan2(y, x)) + 180 WHEN degrees(atan2(y, x)) >= 180 THEN degrees(atan2(y, x)) - 180 ELSE degrees(atan2(y, x)) END AS a FROM (SELECT segment_id, (k % 13) - 6.5E0 AS x, (k % 7) - 3.25E0 AS y FROM segments_v) q) q", SEG)
def wall_angles(spark, sf):
    df = view(spark, sf, SEG)
    return df.select("segment_id", E.axis_angle((F.col("k") % 13) - 6.5, (F.col("k") % 7) - 3.25).alias("angle"))


_WF = """w AS (SELECT surface, z, CASE WHEN surface < 2 THEN x ELSE y END AS u FROM points_v WHERE surface < 4),
e AS (SELECT surface, min(u) AS u0, max(u) AS u1, min(z) AS z0, max(z) AS z1, count(*) AS points, greatest(0.1, quantile_cont(u, 0.95) - quantile_cont(u, 0.05)) AS length_m, greatest(0.1, quantile_cont(z, 0.95) - quantile_cont(z, 0.05)) AS height_m FROM w GROUP BY 1),
o AS (SELECT surface, count(DISTINCT (floor((u - u0) / 0.25), floor((z - z0) / 0.25))) AS occupied, count(DISTINCT floor(z - z0)) AS metres FROM w JOIN e USING (surface) GROUP BY 1),
f AS (SELECT surface, points, length_m, height_m, points / greatest(0.05, length_m * height_m) AS density, occupied / ((floor((u1 - u0) / 0.25) + 1) * (floor((z1 - z0) / 0.25) + 1)) AS fill, metres / ceil(greatest(1.0, z1 - z0)) AS z_continuity FROM e JOIN o USING (surface))"""


def _wall_features(spark, sf):
    return walls.plane_features(view(spark, sf, PTS).filter("surface < 4").withColumn("u", F.when(F.col("surface") < 2, F.col("x")).otherwise(F.col("y"))), "surface")


@query(f"WITH {_WF} SELECT surface, points, round_even(length_m, 6) AS length_m, round_even(height_m, 6) AS height_m, round_even(density, 4) AS density, round_even(fill, 6) AS fill, round_even(z_continuity, 6) AS z_continuity FROM f", PTS)
def wall_features(spark, sf):
    return _wall_features(spark, sf).select("surface", "points", F.bround("length_m", 6).alias("length_m"), F.bround("height_m", 6).alias("height_m"), F.bround("density", 4).alias("density"), F.bround("fill", 6).alias("fill"), F.bround("z_continuity", 6).alias("z_continuity"))


@query(
    f"""WITH {_WF}, g AS (SELECT *, surface <> 2 AS aligned, surface * 1.0E0 AS centre_m, surface * 0.15E0 AS curvature FROM f),
s AS (SELECT *, greatest(0.0, least(1.0, (0.18 * least(height_m / 6, 1.0) + 0.18 * least(length_m / 4, 1.0) + 0.24 * greatest(0.0, least((fill - 0.15) / 0.45, 1.0)) + 0.14 * greatest(0.0, least((density - 15) / 75, 1.0)) + 0.10 + 0.08 * aligned::INT + 0.08 * CASE WHEN centre_m > 2 THEN 1.0 WHEN aligned THEN 0.5 ELSE 0 END) * CASE WHEN aligned THEN 1 ELSE 0.8 END * CASE WHEN curvature > 0.3 THEN greatest(0.1, 1 - 0.75 * curvature) ELSE 1 END)) AS score FROM g)
SELECT surface, round_even(score, 6) AS score, {rules_sql.PLANE_CLASS} AS class FROM s""",
    PTS,
)
def wall_classes(spark, sf):
    rows = _wall_features(spark, sf).withColumns({"normals": F.lit(1.0), "aligned": F.col("surface") != 2, "centre_m": F.col("surface") * F.lit(1.0), "curvature": F.col("surface") * F.lit(0.15)})
    return walls.wall_classes(rows).select("surface", F.bround("score", 6).alias("score"), "class")
