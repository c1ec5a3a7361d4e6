"""Segments as JSON, handover CSV, minimal STEP text, floor-plan SVG, JUnit totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.segments import ranked

SEGMENT = "segment_id string, zone_id string, shape string, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double, cx double, cy double, cz double, point_count long, confidence double"


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON lines with the segment schema; a row that doesn't parse fails the read."""
    return spark.read.schema(SEGMENT).option("mode", "FAILFAST").json(path)


def write_segments(segments: DataFrame, path: str) -> None:
    segments.select(*[c.split()[0] for c in SEGMENT.split(", ")]).write.mode("overwrite").json(path)


def write_handover_csv(rows: DataFrame, path: str) -> None:
    """One row for each tag and attribute, POPULATED before PENDING within a file."""
    rows.repartitionByRange("tag").sortWithinPartitions(F.col("status").desc(), "tag", "attribute").write.mode("overwrite").csv(path, header=True)


def step_lines(elements: DataFrame) -> DataFrame:
    """line: a minimal exchange text, one entity for each element with its box, numbered over all rows."""
    rows = ranked(elements.select("segment_id", "element_type", "min_x", "min_y", "min_z", "max_x", "max_y", "max_z"), ["segment_id"], "n")
    entity = F.upper(F.regexp_replace("element_type", "_", ""))
    return rows.select("n", F.format_string("#%d=IFC%s('%s',(%.1f,%.1f,%.1f),(%.1f,%.1f,%.1f));", F.col("n") + 100, entity, "segment_id", "min_x", "min_y", "min_z", "max_x", "max_y", "max_z").alias("line"))


def svg_shapes(segments: DataFrame, scale: float = 0.02) -> DataFrame:
    """One SVG rectangle for each segment's plan."""
    at = lambda c: F.round(F.col(c) * scale, 2)
    return segments.select("segment_id", F.format_string('<rect id="%s" x="%.2f" y="%.2f" width="%.2f" height="%.2f"/>', "segment_id", at("min_x"), at("min_y"), F.round((F.col("max_x") - F.col("min_x")) * scale, 2), F.round((F.col("max_y") - F.col("min_y")) * scale, 2)).alias("shape"))


def junit_totals(spark: SparkSession, path: str) -> DataFrame:
    """Tests, failures, errors and skips of JUnit XML files, by Spark's XML reader."""
    cases = spark.read.format("xml").option("rowTag", "testcase").schema("_name string, failure string, error string, skipped string").load(path)
    return cases.agg(F.count("*").alias("tests"), F.count("failure").alias("failures"), F.count("error").alias("errors"), F.count("skipped").alias("skipped"))
