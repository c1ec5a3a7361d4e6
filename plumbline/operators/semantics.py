"""Colours, taxonomies, fused confidences and point semantics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as E

# Source labels and the canonical label of each.
TAXONOMY = {
    "s3dis": {"ceiling": "CEILING", "floor": "FLOOR", "wall": "WALL", "beam": "BEAM", "column": "COLUMN", "window": "WINDOW", "door": "DOOR", "table": "FURNITURE", "chair": "FURNITURE"},
    "scan": {"plane_vertical": "WALL", "plane_horizontal": "FLOOR", "plane_sloped": "STAIR", "cylinder": "PIPE", "void": "OPENING"},
}


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    """#RRGGBB of channels in 0 to 255."""
    two = lambda c: F.lpad(F.hex(F.bround(c).cast("long")), 2, "0")
    return F.concat(F.lit("#"), two(r), two(g), two(b))


def dominant_colours(points: DataFrame, by: str) -> DataFrame:
    """Mean colour as text and the mean of the channels' population variances of each group."""
    s = points.groupBy(by).agg(*[F.avg(c).alias(c) for c in "rgb"], *[F.var_pop(c).alias(f"v{c}") for c in "rgb"], F.count("*").alias("n"))
    return s.select(by, "n", hex_colour(F.col("r"), F.col("g"), F.col("b")).alias("colour"), F.bround((F.col("vr") + F.col("vg") + F.col("vb")) / 3, 4).alias("variance"))


def colour_groups(points: DataFrame, step: int = 32, most: int = 12, least: int = 120, share: float = 0.01) -> DataFrame:
    """Points of each quantised colour: saturated ones by bucket if the bucket is among the largest and big enough, else misc; the rest grey."""
    high, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    saturation = F.coalesce(F.try_divide(high - low, high), F.lit(0.0))
    bucket = F.when(saturation > 0.05, F.concat_ws("-", *[F.floor(F.col(c) / step).cast("string") for c in "rgb"]))
    counts = points.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    # A row for each bucket, of which there are (256 / step) cubed at most.
    total = F.sum(F.when(F.col("bucket").isNotNull(), F.col("n"))).over(W.partitionBy())
    rank = F.row_number().over(W.partitionBy(F.col("bucket").isNull()).orderBy(F.col("n").desc(), "bucket"))
    keep = (F.col("rank") <= most) & ((F.col("n") >= least) | (F.col("n") >= share * F.col("total")))
    named = counts.withColumns({"total": total, "rank": rank}).select(F.when(F.col("bucket").isNull(), "grey").when(keep, F.col("bucket")).otherwise("misc").alias("grp"), "n")
    return named.groupBy("grp").agg(F.sum("n").alias("n"))


def mapped(rows: DataFrame, taxonomy: str, label: str = "label") -> DataFrame:
    """Adds the canonical label, UNSUPPORTED where the taxonomy has none."""
    table = F.create_map(*(F.lit(x) for kv in TAXONOMY[taxonomy].items() for x in kv))
    return rows.withColumn("canonical", F.coalesce(F.try_element_at(table, F.col(label)), F.lit("UNSUPPORTED")))


def support_score(points: Column, rmse_m: Column, area_m2: Column) -> Column:
    """0.4 of the count (50 is full), 0.4 of the fit (5 cm is none), 0.2 of the area (half a square metre is full)."""
    return 0.4 * F.least(F.lit(1.0), points / 50) + 0.4 * F.greatest(F.lit(0.0), 1 - rmse_m / 0.05) + 0.2 * F.least(F.lit(1.0), area_m2 / 0.5)


def fused(rows: DataFrame) -> DataFrame:
    """Overall confidence of rows with geometry, points, rmse_m, area_m2, semantic and context."""
    support = support_score(F.col("points"), F.col("rmse_m"), F.col("area_m2"))
    return rows.withColumn("support", F.bround(support, 6)).withColumn("confidence", F.bround(0.35 * F.col("geometry") + 0.30 * support + 0.20 * F.col("semantic") + 0.15 * F.col("context"), 6))


def point_classes(points: DataFrame) -> DataFrame:
    """Labels by normal (nz) and height within the cloud: horizontal low is floor, horizontal high is ceiling, upright is wall."""
    span = points.agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    rel = F.coalesce(F.try_divide(F.col("z") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    label = E.case([(F.abs("nz") <= 0.35, F.lit("WALL")), ((F.abs("nz") >= 0.70) & (rel < 0.40), F.lit("FLOOR")), (F.abs("nz") >= 0.70, F.lit("CEILING"))], F.lit("UNKNOWN"))
    return points.crossJoin(F.broadcast(span)).select("point_id", label.alias("label"))


def reinforced(relations: DataFrame, weight: float = 0.15, cap: float = 0.40) -> DataFrame:
    """How much an element's relations raise its confidence: a part of their sum, up to the cap. A row may stand for `n` relations."""
    n = F.col("n") if "n" in relations.columns else F.lit(1).cast("long")
    return relations.groupBy("a").agg(F.sum(n).alias("relations"), F.bround(F.least(F.lit(cap), weight * F.sum(F.col("confidence") * n)), 6).alias("boost"))


def identity(segments: DataFrame) -> DataFrame:
    """A name that follows from the segment's content: zone, shape, centroid and box, rounded to a tenth."""
    one = lambda c: F.format_string("%.1f", F.col(c))
    text = F.concat_ws("|", "zone_id", "shape", *[one(c) for c in ("cx", "cy", "cz", "min_x", "min_y", "min_z", "max_x", "max_y", "max_z")])
    return segments.select("segment_id", F.substring(F.sha2(text, 256), 1, 32).alias("content_id"))


def output_hash(rows: DataFrame, by: str, key: str) -> DataFrame:
    """A hash of each group's names that doesn't depend on order or partitions, and is summed without gathering the group:
    the sum of their 60-bit hashes, and their number."""
    h = F.conv(F.substring(F.sha2(F.col(key), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(h).cast("string").alias("hash"))


# What an open-world guess needs, and how its two sources weigh.
GEOMETRY_SHARE, NEURAL_SHARE = 0.55, 0.45


def open_world(rows: DataFrame, least: float = 0.45, margin: float = 0.10) -> DataFrame:
    """label, score and margin for rows with maps `geometric` and `neural` of scores by label: the best fused one, UNKNOWN where it is
    too low or too near the second. A label that one source lacks has 0 there; without a neural map geometry counts alone."""
    alone = F.col("neural").isNull() | (F.size("neural") == 0)
    labels = F.array_union(F.map_keys(F.coalesce("geometric", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))), F.when(alone, F.array().cast("array<string>")).otherwise(F.map_keys("neural")))
    of = lambda m, x: F.coalesce(F.try_element_at(F.col(m), x), F.lit(0.0))
    fused = F.transform(labels, lambda x: F.struct((-F.when(alone, of("geometric", x)).otherwise(GEOMETRY_SHARE * of("geometric", x) + NEURAL_SHARE * of("neural", x))).alias("s"), x.alias("label")))
    out = rows.withColumn("ranked", F.array_sort(fused))
    first, second = F.try_element_at("ranked", F.lit(1)), F.try_element_at("ranked", F.lit(2))
    score, gap = F.coalesce(-first["s"], F.lit(0.0)), F.coalesce(-first["s"] + F.coalesce(second["s"], F.lit(0.0)), F.lit(0.0))
    sure = (score >= least) & (gap >= margin)
    return out.withColumns({"label": F.when(sure, first["label"]).otherwise("UNKNOWN"), "score": score, "margin": gap}).drop("ranked")


def enforced(nodes: DataFrame) -> DataFrame:
    """Confidence of doors without a host times 0.4, of pipes without a connection times 0.6 (columns element_type, host, connections)."""
    bare = F.coalesce(F.size("connections"), F.lit(0)) <= 0
    return nodes.withColumn("confidence", F.col("confidence") * F.when((F.col("element_type") == "door") & F.col("host").isNull(), 0.4).when((F.col("element_type") == "pipe") & bare, 0.6).otherwise(1.0))


def banded(segments: DataFrame, step_mm: float = 3000.0) -> DataFrame:
    """Segments moved up or down so that their mid height is a multiple of the step, halves to the even one; a step of 0 moves none."""
    if step_mm <= 0:
        return segments
    mid = (F.col("min_z") + F.col("max_z")) / 2
    shift = F.bround(mid / step_mm) * step_mm - mid
    return segments.withColumn("shift", shift).withColumns({c: F.col(c) + F.col("shift") for c in ("min_z", "max_z", "cz")}).drop("shift")


def wall_confidence(points: Column, area_m2: Column, nz: Column, rmse_m: Column) -> Column:
    """0.35 of the points (1800 are full), 0.25 of the area (12 m2), 0.2 of uprightness (0.3 is none), 0.2 of the fit (6 cm is none)."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return unit(0.35 * F.least(F.lit(1.0), points / 1800) + 0.25 * F.least(F.lit(1.0), area_m2 / 12) + 0.20 * F.greatest(F.lit(0.0), 1 - F.abs(nz) / 0.30) + 0.20 * unit(1 - F.coalesce(rmse_m, F.lit(0.05)) / 0.06))


def claimed(claims: DataFrame, supported: DataFrame) -> DataFrame:
    """Claims (model, label) with whether the model's label space (supported: model, label) has the label."""
    return claims.join(supported.select("model", "label").distinct().withColumn("valid", F.lit(True)), ["model", "label"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))
