"""Filters, projections and classification of detected segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..storage import stored

# Reasons and limits (mm) in the order in which they are looked at.
VIABILITY = [("max_e < 50", "major_span_lt_50mm"), ("shape <> 'void' AND point_count <= 0", "non_void_zero_points"), ("shape <> 'void' AND mid_e < 20", "mid_span_lt_20mm"), ("shape <> 'void' AND min_e < 3", "minor_span_lt_3mm")]
VALIDITY = [
    ("min_x <> min_x OR max_x <> max_x OR min_y <> min_y OR max_y <> max_y OR min_z <> min_z OR max_z <> max_z", "not_a_number"),
    ("max_x < min_x OR max_y < min_y OR max_z < min_z", "inverted_box"),
    ("max_e < 10", "degenerate_box"),
    ("cx < min_x - 1 OR cx > max_x + 1 OR cy < min_y - 1 OR cy > max_y + 1 OR cz < min_z - 1 OR cz > max_z + 1", "centroid_outside"),
]

_PIPE = "max_e >= 800 AND max_e / greatest(mid_e, 1) >= 2.5 AND mid_e / greatest(min_e, 1) <= 3 AND mid_e / greatest(max_e, 1) <= 0.25 AND max_e >= 2500 AND min_e <= 250 AND mid_e <= 450 AND max_e / greatest(mid_e, 1) >= 5 AND mid_e / greatest(min_e, 1) <= 1.8"
_UP = "(h > w AND h > d)"
_F = "(max_e / greatest(mid_e, 1))"
_DIA = "((min_e + mid_e) / 2.0E0)"
_AR = f"(max_e / greatest({_DIA}, 1))"
_FLAT = "(min_e / greatest(mid_e, 1))"
# A tray is low against its width, not too high above the floor, no pipe, and scores 2.5 of its traits.
_TRAY = (
    f"max_e >= 1200 AND NOT {_UP} AND min_e <= 320 AND mid_e <= 700 AND greatest(w, d) / greatest(h, 1) >= 2 AND rz >= 800 AND rz <= 4500 AND h >= 120 AND greatest(w, d) >= 240 AND h <= 0.65 * greatest(w, d) AND {_FLAT} < 0.75"
    f" AND CASE WHEN {_F} >= 2.2 THEN 1 ELSE 0 END + CASE WHEN {_FLAT} >= 0.2 AND {_FLAT} <= 0.6 THEN 1 ELSE 0 END + 0.75 + CASE WHEN greatest(w, d) / greatest(h, 1) >= 2.2 THEN 0.5 ELSE 0 END + CASE WHEN rz < 3500 THEN 0.5 ELSE 0 END + CASE WHEN {_F} >= 1.8 THEN 0.25 ELSE 0 END + CASE WHEN point_count >= 24 THEN 0.25 ELSE 0 END >= 2.5"
)
_EXT = f"({_UP} AND cz >= 700 AND cz <= 1800 AND min_e > 90 AND min_e < 300 AND mid_e < 380 AND max_e > 300 AND max_e < 1100)"

# Element type by shape: rules in order, the first that holds counts. Sizes in mm; min_e, mid_e, max_e are the sorted
# extents, w, d, h those along x, y, z, and rz is the centroid's height above the floor datum.
_BEFORE = [("point_count <= 0 AND shape <> 'void'", "unknown"), ("max_e < 50", "unknown")]
TYPES: dict[str, tuple[list[tuple[str, str]], str]] = {
    "valve_candidate": (
        [("max_e < 160 AND mid_e < 100 AND h > w AND h > d", "safety_relief_valve"), ("max_e < 200 AND h <= w", "expansion_joint"), ("min_e < 120 AND mid_e < 200 AND max_e < 320", "strainer"), ("max_e > 450", "deluge_valve")],
        "valve",
    ),
    "plane_vertical": ([("h > 80 AND h < 600", "bund_wall"), ("greatest(w, d) < 800 AND greatest(w, d) / greatest(least(w, d, 1.0E0), 1.0E-9) < 3", "column")], "wall"),
    "plane_horizontal": ([("point_count / greatest(w * d / 1.0E6, 0.01E0) < 20 AND w * d > 250000", "grating"), ("rz > 1800", "ceiling")], "floor"),
    "plane_sloped": ([("h >= 700 AND h / greatest(w, d, 1) >= 0.35", "stair")], "ramp"),
    "void": (
        [
            ("h < 400 AND w * d > 90000 AND greatest(w, d) / greatest(least(w, d), 1) > 5", "trench"),
            ("h < 400 AND w * d > 90000 AND w * d < 600000", "hatch"),
            ("h < 400 AND w * d > 90000 AND point_count <= 0", "unknown"),
            ("h < 400 AND w * d > 90000", "slab_opening"),
            ("min_z - datum < 300", "door"),
        ],
        "window",
    ),
    "cylinder": (
        [
            (f"{_DIA} > 1500 AND max_e > 10000", "steam_generator"),
            (f"{_DIA} > 400 AND {_DIA} < 1600 AND {_AR} > 7 AND max_e > 5000", "pressurizer"),
            (f"{_DIA} > 200 AND {_DIA} < 1500 AND {_AR} > 3 AND {_AR} <= 7 AND max_e > 1000", "heat_exchanger"),
            (f"{_DIA} > 300 AND {_DIA} < 2500 AND {_AR} >= 1 AND {_AR} <= 3 AND max_e > 1000 AND w * d * h > 1.0E9", "pressure_vessel"),
            (f"{_DIA} > 300 AND {_DIA} < 2500 AND {_AR} >= 1 AND {_AR} <= 3 AND max_e > 1000", "tank"),
            (f"{_DIA} > 250 AND max_e < 150 AND rz < 500", "seismic_isolator"),
            (f"{_DIA} >= 80 AND {_DIA} <= 250 AND max_e >= 300 AND max_e <= 900 AND rz >= 700 AND rz <= 1800", "fire_extinguisher"),
            (f"max_e >= 120 AND {_AR} >= 1.6 AND {_DIA} >= 30 AND {_DIA} <= 500", "pipe"),
            ("max_e < 180 AND rz > 2400 AND max_e < 80", "smoke_detector"),
            (f"max_e < 180 AND rz > 600 AND rz < 900 AND {_DIA} > 40", "fire_hydrant"),
            ("max_e < 180 AND rz > 2200", "sprinkler"),
            (f"max_e < 180 AND rz < 200 AND {_AR} < 1.8", "drainage"),
            ("max_e < 180", "valve"),
            (f"{_DIA} > 1200", "tank"),
            (f"{_DIA} < 60", "conduit"),
        ],
        "pipe",
    ),
    "box": (
        [
            (_PIPE, "pipe"),
            (f"point_count < 12 AND max_e < 500 AND NOT {_EXT}", "unknown"),
            (_TRAY, "cable_tray"),
            (f"rz > 4000 AND max_e > 5000 AND NOT {_UP}", "overhead_crane"),
            ("min_e > 800 AND mid_e > 1000 AND max_e > 3000", "emergency_diesel_generator"),
            ("min_e > 500 AND mid_e > 600 AND max_e > 800 AND max_e < 4000 AND rz < 2500", "transformer"),
            ("min_e > 350 AND mid_e > 450 AND max_e > 1500 AND rz < 1500", "compressor"),
            ("min_e < 700 AND mid_e > 400 AND max_e > 1500 AND rz >= 800 AND rz <= 2000", "switchgear"),
            ("min_e > 200 AND min_e < 700 AND mid_e > 200 AND mid_e < 700 AND max_e > 2000 AND rz < 1200", "ups_system"),
            (f"{_UP} AND h > 2000 AND min_e < 600 AND mid_e < 600", "ladder"),
            (_EXT, "fire_extinguisher"),
            (f"max_e > 700 AND {_F} > 3 AND min_e < 220 AND mid_e <= 120", "conduit"),
            (f"max_e > 700 AND {_F} > 3 AND min_e < 220 AND rz > 2400 AND min_e < 180 AND mid_e < 280", "lighting_fitting"),
            (f"max_e > 700 AND {_F} > 3 AND min_e < 220", "beam"),
            (f"min_e < 120 AND mid_e < 220 AND max_e > 80 AND max_e < 420 AND rz > 800 AND rz < 2600 AND {_F} < 2.2 AND point_count >= 20", "radiation_monitor"),
            ("min_e < 100 AND mid_e > 150 AND mid_e < 600 AND max_e < 700 AND rz > 1000 AND rz < 2200", "fire_alarm_panel"),
            ("min_e < 100 AND mid_e < 300 AND max_e < 300", "junction_box"),
            (f"min_e < 120 AND max_e > 250 AND max_e < 1000 AND {_F} > 2.5 AND rz > 500 AND rz < 3500", "pipe_support"),
            ("rz > 2200 AND min_e < 200 AND max_e > 200 AND max_e < 2000", "lighting_fitting"),
            (f"rz < 150 AND max_e > 350 AND max_e < 1400 AND NOT {_UP}", "kerb"),
            (f"rz < 150 AND min_e < 220 AND {_F} < 2.2 AND max_e < 600", "drainage"),
            ("rz >= 800 AND rz <= 1200 AND min_e < 200", "railing"),
            (f"min_e < 250 AND mid_e > 400 AND {_F} < 3 AND rz >= 1000 AND rz <= 2000", "electrical_panel"),
            (f"{_F} >= 2.5 AND NOT {_UP} AND rz > 1800", "beam"),
            ("min_e > 400 AND mid_e > 400 AND rz < 1000", "pump"),
            ("min_e > 400 AND mid_e > 400", "hvac_equipment"),
        ],
        "generic_model",
    ),
}

# Disciplines by element type; structural where a type is not named.
DISCIPLINES = {
    "architectural": ["ceiling", "stair", "ramp", "door", "window", "railing", "ladder", "grating", "hatch"],
    "civil": ["trench", "bund_wall", "kerb"],
    "mep": [
        "pipe", "conduit", "duct", "cable_tray", "hvac_equipment", "tank", "pump", "valve", "safety_relief_valve", "strainer", "expansion_joint", "pipe_support", "drainage", "electrical_panel", "pressure_vessel",
        "heat_exchanger", "compressor", "pressurizer", "steam_generator", "emergency_diesel_generator", "radiation_monitor", "transformer", "switchgear", "ups_system", "junction_box", "lighting_fitting",
    ],
    "fire_protection": ["sprinkler", "fire_hydrant", "fire_extinguisher", "deluge_valve", "fire_alarm_panel", "smoke_detector", "fire_damper"],
}

# Types that authoring tools get as a core type.
CORE = {"bund_wall": "wall", "hatch": "slab_opening", "trench": "slab_opening"}

# Safety category by rule, in order, and zone of explosive atmosphere by type.
SAFETY = [
    ("element_type = 'wall' AND h > 3500 AND w > 8000 AND point_count / greatest(w * h / 1.0E6, 1.0E-6) >= 5", "SC1"),
    ("element_type = 'door'", "SC2"),
    ("element_type = 'window'", "NS"),
    ("element_type = 'railing'", "SC3"),
    ("element_type = 'beam' AND confidence < 0.75", "SC2"),
    ("element_type = 'stair'", "SC3"),
    ("element_type = 'ramp'", "NS"),
    ("element_type = 'column' AND h > 3000 AND confidence < 0.75", "SC2"),
    ("element_type = 'wall' AND h > 3200 AND point_count > 3000", "SC3"),
    ("element_type IN ('tank', 'hvac_equipment', 'pump', 'duct', 'pipe')", "SC3"),
    ("element_type IN ('valve', 'sprinkler', 'slab_opening')", "SC2"),
    ("element_type = 'electrical_panel'", "SC3"),
    ("element_type IN ('containment_penetration', 'pressurizer', 'steam_generator', 'emergency_diesel_generator', 'safety_relief_valve')", "SC1"),
    ("element_type IN ('pressure_vessel', 'heat_exchanger', 'transformer', 'ups_system', 'fire_hydrant', 'deluge_valve', 'fire_alarm_panel', 'penetration_seal', 'overhead_crane', 'compressor', 'seismic_isolator', 'radiation_monitor')", "SC2"),
    ("element_type IN ('switchgear', 'fire_damper', 'strainer', 'expansion_joint', 'bund_wall', 'fire_extinguisher', 'smoke_detector')", "SC3"),
]
EXPLOSIVE = [("element_type IN ('tank', 'pipe')", "Zone2"), ("element_type IN ('valve', 'pressure_vessel', 'heat_exchanger', 'compressor')", "Zone1")]

MEASURES = "max_x - min_x AS w, max_y - min_y AS d, max_z - min_z AS h, least(max_x - min_x, max_y - min_y, max_z - min_z) AS min_e, (max_x - min_x) + (max_y - min_y) + (max_z - min_z) - least(max_x - min_x, max_y - min_y, max_z - min_z) - greatest(max_x - min_x, max_y - min_y, max_z - min_z) AS mid_e, greatest(max_x - min_x, max_y - min_y, max_z - min_z) AS max_e"


def measured(segments: DataFrame, datum: float = 0.0) -> DataFrame:
    """Adds w, d, h, the sorted extents, the floor datum and rz, the centroid's height above it."""
    low, mid, high = E.sorted_extents()
    return segments.withColumns({"w": E.extent("x"), "d": E.extent("y"), "h": E.extent("z"), "min_e": low, "mid_e": mid, "max_e": high, "datum": F.lit(datum), "rz": F.col("cz") - F.lit(datum)})


def type_sql(shape: str) -> str:
    rules, other = TYPES[shape]
    return E.case_sql(_BEFORE + rules, other)


def element_type() -> Column:
    """The element type of a measured segment: one CASE for each shape, so that each stays small enough to compile."""
    whole = None
    for shape in TYPES:
        arm = F.expr(type_sql(shape))
        whole = F.when(F.col("shape") == shape, arm) if whole is None else whole.when(F.col("shape") == shape, arm)
    return whole.otherwise(F.lit("unknown"))


def discipline() -> Column:
    return E.case([(F.col("element_type").isin(types), F.lit(name)) for name, types in DISCIPLINES.items()], F.lit("structural"))


def classified(segments: DataFrame, datum: float = 0.0, core: bool = True, override: Column | None = None) -> DataFrame:
    """Measured segments with element_type, discipline, safety_category and dsear_zone; one pass, no shuffle.

    `core` names special types by the core type that authoring tools expect, before discipline and safety are looked up. A
    category that `override` gives (a zone's, say) counts before all rules, without an explosive zone; null leaves them.
    """
    kind = element_type()
    if core:
        # An explode of one element: the optimizer would otherwise copy the large CASE into every condition on the type.
        df = measured(segments, datum).select("*", F.explode(F.array(kind)).alias("found"))
        names = F.create_map(*(F.lit(x) for kv in CORE.items() for x in kv))
        df = df.withColumn("element_type", F.coalesce(F.try_element_at(names, F.col("found")), F.col("found"))).drop("found")
    else:
        df = measured(segments, datum).select("*", F.explode(F.array(kind)).alias("element_type"))
    category, zone = F.expr(E.case_sql(SAFETY, "NS")), F.expr(E.case_sql(EXPLOSIVE, "none"))
    if override is not None:
        category, zone = F.coalesce(override, category), F.when(override.isNotNull(), "none").otherwise(zone)
    return df.withColumns({"discipline": discipline(), "safety_category": category, "dsear_zone": zone})


def viability(segments: DataFrame) -> DataFrame:
    """Adds the first reason why a segment makes no instruction, null if it is viable."""
    return measured(segments).withColumn("reason", F.nullif(F.expr(E.case_sql(VIABILITY, "")), F.lit("")))


def validity(segments: DataFrame) -> DataFrame:
    """Adds the first reason why the geometry is invalid, null if it is valid."""
    return measured(segments).withColumn("reason", F.nullif(F.expr(E.case_sql(VALIDITY, "")), F.lit("")))


def instruction_order(classified_segments: DataFrame) -> DataFrame:
    """seq by phase, shape, surest and densest first, then height and place. A total order over all rows is wanted, so
    positions come from per-range ranks and range offsets, not from one task that sorts everything."""
    phase = F.when(F.col("element_type").isin("wall", "bund_wall"), 0).when(F.col("shape").isin("cylinder", "valve_candidate", "box", "void"), 1).otherwise(2)
    rank = E.case([(F.col("shape") == s, F.lit(i)) for i, s in enumerate(("plane_vertical", "void", "cylinder", "valve_candidate", "box", "plane_sloped", "plane_horizontal"))], F.lit(99))
    keyed = classified_segments.select("segment_id", phase.alias("phase"), rank.alias("shape_rank"), (-F.col("confidence")).alias("c"), (-F.col("point_count")).alias("n"), "cz", "cx", "cy")
    return ranked(keyed, ["phase", "shape_rank", "c", "n", "cz", "cx", "cy", "segment_id"], "seq").select("segment_id", "phase", "shape_rank", "seq")


def ranked(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Adds the position (from 1) in the order `by`, unique keys at its end, over all rows without gathering them in one task.

    Rows are range-partitioned and sorted; each partition's rows are numbered and shifted by the sizes of those before it.
    """
    rows = df.repartitionByRange(*by).withColumn("__p", F.spark_partition_id())
    rows = stored(rows.sortWithinPartitions(*by).withColumn("__m", F.monotonically_increasing_id()), "ranked")
    sizes = {r["__p"]: (r["n"], r["m"]) for r in rows.groupBy("__p").agg(F.count("*").alias("n"), F.min("__m").alias("m")).collect()}
    offsets, total = [], 0
    for p in sorted(sizes):
        offsets.append((p, total - sizes[p][1] + 1))
        total += sizes[p][0]
    # One row for each partition, whose number is bounded.
    shift = df.sparkSession.createDataFrame(offsets or [(-1, 0)], "__p int, __o long")
    return rows.join(F.broadcast(shift), "__p").withColumn(name, F.col("__m") + F.col("__o")).drop("__p", "__m", "__o")
