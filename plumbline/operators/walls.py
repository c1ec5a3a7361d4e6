"""Walls and levels: chains of horizontal surfaces, grouping of wall fragments, pairing of faces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import exprs as E
from . import spatial
from .components import components


def level_clusters(segments: DataFrame, gap_mm: float = 350.0) -> DataFrame:
    """Clusters of horizontal surfaces whose heights follow each other within the gap, and their mean height by points.

    Heights are put into bins as wide as the gap first: a cluster is a run of bins, so only bins, bounded by the building's
    height, are ordered in one task; a run is split where the highest of one bin and the lowest of the next are too far apart.
    """
    own = segments.filter("shape = 'plane_horizontal'").withColumn("bin", F.floor(F.col("cz") / gap_mm))
    bins = own.groupBy("bin").agg(F.min("cz").alias("lo"), F.max("cz").alias("hi"), F.count("*").alias("n"), F.sum(F.col("cz") * F.col("point_count")).alias("s"), F.sum("point_count").alias("p"))
    order = W.orderBy("bin")
    new = F.when(F.col("lo") - F.lag("hi").over(order) <= gap_mm, 0).otherwise(1)
    runs = bins.withColumn("new", new).withColumn("cluster", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("cluster").agg(F.sum("n").alias("n"), F.bround(F.sum("s") / F.sum("p"), 1).alias("level_mm"), F.sum("p").alias("points"))


def levels(segments: DataFrame, apart_mm: float = 1200.0, reach_mm: float = 2000.0, storey_mm: float = 3000.0) -> list[float]:
    """Storey heights: clusters at least `apart_mm` above the last kept one, with the base and top where these are far, two at least.

    The fold over clusters is sequential; there is a row for each cluster, some tens in a building.
    """
    found = sorted(r["level_mm"] for r in level_clusters(segments).collect() if r["level_mm"] is not None)
    ends = segments.agg(F.min("min_z"), F.max("max_z")).first()
    kept: list[float] = []
    for z in found:
        if not kept or z - kept[-1] >= apart_mm:
            kept.append(z)
    if ends[0] is None:
        return []
    if not kept or kept[0] - ends[0] > reach_mm:
        kept.insert(0, ends[0])
    if ends[1] - kept[-1] > reach_mm:
        kept.append(ends[1])
    if len(kept) < 2:
        kept.append(kept[0] + storey_mm)
    return sorted({round(z, 1) for z in kept})


def wall_edges(walls: DataFrame, offset_mm: float = 80.0, gap_mm: float = 1200.0) -> DataFrame:
    """Pairs of vertical planes of one direction that lie in a line: near across, near along, and overlapping in height."""
    along_x = (E.extent("x") >= E.extent("y")).alias("along_x")
    own = walls.filter("shape = 'plane_vertical'").select("*", along_x)
    pairs = spatial.box_pairs(own, own, gap_mm).filter("a.k < b.k AND a.along_x = b.along_x")
    across = F.when(F.col("a.along_x"), F.abs(F.col("a.cy") - F.col("b.cy"))).otherwise(F.abs(F.col("a.cx") - F.col("b.cx")))
    along = F.when(F.col("a.along_x"), E.gap("x")).otherwise(E.gap("y"))
    shared = -E.gap("z")
    height = F.least(E.extent("z", "a"), E.extent("z", "b"))
    return pairs.filter((across <= offset_mm) & (along <= gap_mm) & ((shared >= 0.30 * height) | (shared >= 250))).select(F.col("a.k").alias("a"), F.col("b.k").alias("b"))


def wall_groups(walls: DataFrame, offset_mm: float = 80.0, gap_mm: float = 1200.0) -> DataFrame:
    """Merged walls: the components of wall_edges, each with its united box, points and surest confidence."""
    own = walls.filter("shape = 'plane_vertical'")
    root = components(wall_edges(walls, offset_mm, gap_mm)).withColumnRenamed("node", "k")
    grouped = own.join(root, "k", "left").withColumn("wall", F.coalesce("root", "k"))
    return grouped.groupBy("wall").agg(F.count("*").alias("fragments"), *[F.min(f"min_{a}").alias(f"min_{a}") for a in "xyz"], *[F.max(f"max_{a}").alias(f"max_{a}") for a in "xyz"], F.sum("point_count").alias("points"), F.max("confidence").alias("confidence"))


def face_candidates(walls: DataFrame, least_mm: float = 50.0, most_mm: float = 450.0) -> DataFrame:
    """Opposing faces of a wall: parallel, a wall's thickness apart, overlapping along and in height. Equal boxes are looked at once."""
    own = walls.filter("shape = 'plane_vertical'").withColumn("along_x", E.extent("x") >= E.extent("y"))
    boxes, members = spatial.classes(own, "k", ["along_x", "cx", "cy", *(f"{m}_{x}" for m in ("min", "max") for x in E.AXES)])
    pairs = spatial.box_pairs(boxes, boxes, most_mm, on=("along_x",)).filter("a.k < b.k OR (a.k = b.k AND a.copies > 1)")
    across = F.when(F.col("a.along_x"), F.abs(F.col("a.cy") - F.col("b.cy"))).otherwise(F.abs(F.col("a.cx") - F.col("b.cx")))
    along = F.when(F.col("a.along_x"), -E.gap("x")).otherwise(-E.gap("y"))
    tall = -E.gap("z") >= 0.25 * F.least(E.extent("z", "a"), E.extent("z", "b"))
    found = pairs.filter(across.between(least_mm, most_mm) & (along > 0) & tall).select(F.col("a.k").alias("a"), F.col("b.k").alias("b"), across.alias("distance_mm"), F.greatest(F.lit(100.0), F.least(F.lit(600.0), across)).alias("thickness_mm"))
    return spatial.spread_once(found, members).select("a", "b", "distance_mm", "thickness_mm")


# Weights of the wall score, and the classes of a vertical plane in the order in which they are looked at.
SCORE = {"height": 0.18, "length": 0.18, "fill": 0.24, "density": 0.14, "normals": 0.10, "aligned": 0.08, "envelope": 0.08}
CLASSES = [
    ("curvature >= 0.55 OR (curvature >= 0.35 AND centre_m < 1.6 AND height_m >= 4.0)", "curved_structural_surface"),
    ("score >= 0.52 AND aligned AND height_m >= 1.8 AND length_m >= 1.5 AND curvature < 0.35", "architectural_wall"),
    ("score >= 0.38 AND aligned AND height_m >= 0.40 AND length_m >= 0.30 AND curvature < 0.40", "wall_fragment"),
    ("(centre_m < 1.3 AND (fill < 0.32 OR density < 30 OR NOT aligned)) OR (fill < 0.20 AND length_m < 2.0) OR (density < 18 AND length_m < 2.0)", "mep_equipment"),
    ("height_m < 1.0 AND length_m < 1.0", "furniture_object"),
    ("length_m < 0.80 AND height_m >= 2.0", "structural_nonwall"),
    ("NOT aligned AND centre_m < 2.0", "mep_equipment"),
]


def plane_features(points: DataFrame, by: str, cell_m: float = 0.25) -> DataFrame:
    """Features of vertical planes from their points (u along the wall and z in metres): robust length and height, density,
    share of occupied cells and of occupied metres of height. Percentiles and distinct cells are partial aggregates."""
    span = lambda c: F.percentile(c, 0.95) - F.percentile(c, 0.05)
    ends = points.groupBy(by).agg(F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("z").alias("z0"), F.max("z").alias("z1"), F.count("*").alias("points"), F.greatest(F.lit(0.1), span("u")).alias("length_m"), F.greatest(F.lit(0.1), span("z")).alias("height_m"))
    cells = points.join(ends.select(by, "u0", "z0"), by).select(by, F.floor((F.col("u") - F.col("u0")) / cell_m).alias("cu"), F.floor((F.col("z") - F.col("z0")) / cell_m).alias("cz"), F.floor(F.col("z") - F.col("z0")).alias("m")).distinct()
    occupied = cells.groupBy(by).agg(F.countDistinct("cu", "cz").alias("occupied"), F.countDistinct("m").alias("metres"))
    whole = (F.floor((F.col("u1") - F.col("u0")) / cell_m) + 1) * (F.floor((F.col("z1") - F.col("z0")) / cell_m) + 1)
    out = ends.join(occupied, by)
    return out.select(by, "points", "length_m", "height_m", (F.col("points") / F.greatest(F.lit(0.05), F.col("length_m") * F.col("height_m"))).alias("density"), (F.col("occupied") / whole).alias("fill"), (F.col("metres") / F.ceil(F.greatest(F.lit(1.0), F.col("z1") - F.col("z0")))).alias("z_continuity"))


def wall_classes(features: DataFrame) -> DataFrame:
    """Adds the wall score and class to rows with length_m, height_m, density, fill, normals (share that agree), aligned, centre_m, curvature."""
    ramp = lambda c, low, width: F.greatest(F.lit(0.0), F.least((F.col(c) - low) / width, F.lit(1.0)))
    parts = {"height": F.least(F.col("height_m") / 6, F.lit(1.0)), "length": F.least(F.col("length_m") / 4, F.lit(1.0)), "fill": ramp("fill", 0.15, 0.45), "density": ramp("density", 15.0, 75.0), "normals": ramp("normals", 0.60, 0.35), "aligned": F.col("aligned").cast("double"), "envelope": F.when(F.col("centre_m") > 2, 1.0).when(F.col("aligned"), 0.5).otherwise(0.0)}
    score = sum((parts[k] * w for k, w in SCORE.items()), F.lit(0.0)) * F.when(F.col("aligned"), 1.0).otherwise(0.8)
    score = score * F.when(F.col("curvature") > 0.30, F.greatest(F.lit(0.10), 1 - 0.75 * F.col("curvature"))).otherwise(1.0)
    return features.withColumn("score", F.greatest(F.lit(0.0), F.least(score, F.lit(1.0)))).withColumn("class", F.expr(E.case_sql(CLASSES, "other")))


def between_levels(segments: DataFrame, base_mm: float, top_mm: float, across_mm: float = 120.0, gap_mm: float = 1200.0) -> DataFrame:
    """Walls of a storey: vertical planes that meet its height are grouped and stand from its floor to its ceiling."""
    own = segments.filter((F.col("shape") == "plane_vertical") & (F.col("min_z") < top_mm) & (F.col("max_z") > base_mm))
    return wall_groups(own, across_mm, gap_mm).withColumns({"min_z": F.lit(float(base_mm)), "max_z": F.lit(float(top_mm))})


def slabs_at(segments: DataFrame, level_mm: float, thick_mm: float = 200.0, reach_mm: float = 500.0) -> DataFrame:
    """The floor of a level: one slab under it as wide as the horizontal planes near it; no row without any."""
    near = segments.filter((F.col("shape") == "plane_horizontal") & (F.abs(F.col("cz") - level_mm) <= reach_mm))
    out = near.agg(F.count("*").alias("parts"), *[F.min(f"min_{a}").alias(f"min_{a}") for a in "xy"], *[F.max(f"max_{a}").alias(f"max_{a}") for a in "xy"], F.sum("point_count").alias("points"))
    return out.filter("parts > 0").withColumns({"min_z": F.lit(level_mm - thick_mm), "max_z": F.lit(float(level_mm))})


def missing_sides(walls: DataFrame, base_mm: float, top_mm: float, reach_mm: float = 600.0, thick_mm: float = 200.0) -> DataFrame:
    """Walls that close a storey: for each side of the walls' extent that no wall lies along, one on it."""
    e = walls.agg(*[F.min(f"min_{a}").alias(f"{a}0") for a in "xy"], *[F.max(f"max_{a}").alias(f"{a}1") for a in "xy"])
    along = walls.crossJoin(F.broadcast(e)).withColumn("along_x", E.extent("x") >= E.extent("y"))
    sides = {"south": ("y", "y0", True), "north": ("y", "y1", True), "west": ("x", "x0", False), "east": ("x", "x1", False)}
    there = along.agg(*[F.coalesce(F.max(((F.col("along_x") == x) & (F.abs(F.col(f"c{a}") - F.col(at)) <= reach_mm)).cast("int")), F.lit(0)).alias(name) for name, (a, at, x) in sides.items()])
    half = thick_mm / 2
    box = lambda a, at, x: F.struct(*([F.col("x0").alias("min_x"), F.col("x1").alias("max_x"), (F.col(at) - half).alias("min_y"), (F.col(at) + half).alias("max_y")] if x else [(F.col(at) - half).alias("min_x"), (F.col(at) + half).alias("max_x"), F.col("y0").alias("min_y"), F.col("y1").alias("max_y")]))
    rows = F.array(*[F.struct(F.lit(name).alias("side"), F.col(name).alias("has"), box(*v).alias("b")) for name, v in sides.items()])
    out = e.crossJoin(F.broadcast(there)).filter("x0 IS NOT NULL").select(F.explode(rows).alias("r")).filter("r.has = 0")
    return out.select("r.side", "r.b.*", F.lit(float(base_mm)).alias("min_z"), F.lit(float(top_mm)).alias("max_z"))
