"""Accuracy, registration, scan quality, failure modes and handover coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E


def loa(statements: DataFrame, measured_sigma_mm: float = 5.0) -> DataFrame:
    """Measured, represented and effective tier (the looser) of rows with segment_id and sigma_mm; a missing sigma counts as 25."""
    represented = E.loa_tier(F.coalesce("sigma_mm", F.lit(25.0)))
    measured = E.loa_tier(F.lit(measured_sigma_mm))
    out = statements.select("segment_id", represented.alias("represented"), measured.alias("measured"))
    return out.withColumn("effective", F.when(E.loa_rank(F.col("represented")) >= E.loa_rank(F.col("measured")), F.col("represented")).otherwise(F.col("measured")))


def tier_distribution(loa_rows: DataFrame) -> DataFrame:
    """Rows of each tier, tiers without rows as 0."""
    tiers = loa_rows.sparkSession.createDataFrame([(name,) for name, _ in E.LOA], "tier string")
    return tiers.join(loa_rows.groupBy(F.col("effective").alias("tier")).agg(F.count("*").alias("n")), "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("n"))


def registration(stations: DataFrame) -> DataFrame:
    """The class of each station."""
    return stations.select("station_index", "source_file", E.rics_class(F.col("rmse_mm"), F.col("inlier_ratio")).alias("category"))


def registration_overall(stations: DataFrame) -> DataFrame:
    """Global error (root of the mean square without the reference station), mean ratio, and the worst class of stations and of these."""
    rank = lambda c: E.case([(c == n, F.lit(i)) for i, (n, _, _) in enumerate(E.RICS)], F.lit(3))
    worst = F.max(rank(E.rics_class(F.col("rmse_mm"), F.col("inlier_ratio"))))
    others = F.when(F.col("station_index") > 0, F.col("rmse_mm") * F.col("rmse_mm"))
    total = stations.agg(F.sqrt(F.avg(others)).alias("g"), F.avg("inlier_ratio").alias("r"), worst.alias("w"))
    names = F.array(*(F.lit(n) for n in ("A", "B", "C", "FAIL")))
    return total.select(F.bround("g", 4).alias("global_rmse_mm"), F.bround("r", 4).alias("mean_ratio"), F.element_at(names, F.greatest(F.col("w"), rank(E.rics_class(F.col("g"), F.col("r")))) + 1).alias("overall"))


def deviation_checks(pairs: DataFrame, tolerance_mm: float = 10.0) -> DataFrame:
    """Rows with structs i (instruction) and s (segment), both boxes with centroids: the larger of the sizes' mean square
    difference and the centroids' distance, and whether it is within the tolerance."""
    size = F.sqrt(sum((E.extent(a, "i") - E.extent(a, "s")) ** 2 for a in E.AXES) / 3)
    centre = F.sqrt(sum((F.col(f"i.c{a}") - F.col(f"s.c{a}")) ** 2 for a in E.AXES))
    worst = F.bround(F.greatest(size, centre), 2)
    return pairs.select(F.col("i.segment_id").alias("segment_id"), worst.alias("deviation_mm"), (worst <= tolerance_mm).alias("passed"))


def deviation_summary(checks: DataFrame) -> DataFrame:
    return checks.agg(F.count("*").alias("n"), F.bround(100.0 * F.avg(F.col("passed").cast("double")), 1).alias("pass_rate"), F.max("deviation_mm").alias("max_mm"), F.bround(F.avg("deviation_mm"), 2).alias("mean_mm"), F.count_if(~F.col("passed")).alias("n_failed"))


def heatmap(deviations: DataFrame, n: str | None = None) -> DataFrame:
    """Rows by colour bucket of their distance; a row counts `n` times."""
    d = F.col("distance_mm")
    bucket = E.case([(d.isNull(), F.lit("unknown")), (d < 5, F.lit("lt5")), (d < 15, F.lit("5_15")), (d < 50, F.lit("15_50"))], F.lit("ge50"))
    return deviations.groupBy(bucket.alias("bucket")).agg((F.sum(n) if n else F.count("*")).alias("n"))


def scan_gate(scans: DataFrame, least_points: int = 1000, least_density: float = 100.0) -> DataFrame:
    """Errors and warnings of rows with zone_id, points, area_m2, noise; passes without errors."""
    density = F.try_divide(F.col("points"), F.col("area_m2"))
    noise = F.try_divide(F.col("noise"), F.col("points"))
    keep = lambda *arms: F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in arms))), ",")
    errors = keep((F.col("points") < least_points, "too_few_points"), (density < least_density, "low_density"))
    warnings = keep((noise > 0.10, "noisy"), (F.col("area_m2") < 1, "small_area"))
    return scans.select("zone_id", F.bround(density, 4).alias("density"), F.bround(noise, 4).alias("noise_ratio"), errors.alias("errors"), warnings.alias("warnings"), (errors == "").alias("passed"))


def fmea(modes: DataFrame) -> DataFrame:
    """Risk number (severity x likelihood x detection) and tier."""
    rpn = F.col("severity") * F.col("likelihood") * F.col("detection")
    return modes.withColumn("rpn", rpn).withColumn("tier", E.case([(F.col("rpn") >= 200, F.lit("HIGH")), (F.col("rpn") >= 100, F.lit("MEDIUM")), (F.col("rpn") >= 50, F.lit("LOW"))], F.lit("MINIMAL")))


def fmea_summary(modes: DataFrame) -> DataFrame:
    return fmea(modes).groupBy("tier").agg(F.count("*").alias("n"), F.max("rpn").alias("max_rpn"), F.count_if(F.col("tests") == 0).alias("untested"))


# Attributes asked for by class of equipment.
ATTRIBUTES = {"pipe": ["diameter", "length", "material"], "valve": ["diameter", "type", "rating"], "pump": ["flow", "head", "power"], "tank": ["volume", "material"]}


def handover(elements: DataFrame) -> DataFrame:
    """One row for each element and attribute asked for: what geometry gives is POPULATED, the rest PENDING."""
    asked = F.create_map(*(x for k, v in ATTRIBUTES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    known = F.create_map(F.lit("diameter"), F.bround((F.col("min_e") + F.col("mid_e")) / 2, 1), F.lit("length"), F.bround("max_e", 1), F.lit("volume"), F.bround(F.col("w") * F.col("d") * F.col("h") / 1e9, 6))
    rows = elements.filter(F.col("element_type").isin(*ATTRIBUTES)).select(F.concat_ws("-", F.upper(F.substring("element_type", 1, 2)), F.substring("segment_id", -6, 6)).alias("tag"), "element_type", F.explode(F.try_element_at(asked, F.col("element_type"))).alias("attribute"), known.alias("known"))
    value = F.try_element_at("known", F.col("attribute"))
    return rows.select("tag", "element_type", "attribute", value.alias("value"), F.when(value.isNotNull(), "POPULATED").otherwise("PENDING").alias("status"))


def coverage(rows: DataFrame) -> DataFrame:
    return rows.groupBy("element_type").agg(F.count("*").alias("asked"), F.count_if(F.col("status") == "POPULATED").alias("populated"), F.bround(100.0 * F.avg((F.col("status") == "POPULATED").cast("double")), 1).alias("pct"))
