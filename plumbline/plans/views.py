"""Scan tables derived from the driver's tables, in SQL that both Spark and DuckDB run: integers first, one cast to DOUBLE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_H = "SELECT p_partkey AS k, p_size, (p_partkey * 7919) % 10007 AS h1, (p_partkey * 104729) % 10007 AS h2, (p_partkey * 1299709) % 10007 AS h3, p_partkey % 7 AS s FROM part"

SEGMENTS = f"""
SELECT k, concat('seg-', lpad(concat('', k), 8, '0')) AS segment_id, concat('Z', k % 5) AS zone_id,
  CASE s WHEN 0 THEN 'plane_vertical' WHEN 1 THEN 'plane_horizontal' WHEN 2 THEN 'cylinder' WHEN 3 THEN 'box' WHEN 4 THEN 'void' WHEN 5 THEN 'plane_sloped' ELSE 'valve_candidate' END AS shape,
  CAST(x0 AS DOUBLE) AS min_x, CAST(y0 AS DOUBLE) AS min_y, CAST(z0 AS DOUBLE) AS min_z,
  CAST(x0 + dx AS DOUBLE) AS max_x, CAST(y0 + dy AS DOUBLE) AS max_y, CAST(z0 + dz AS DOUBLE) AS max_z,
  (2 * x0 + dx) / 2.0E0 AS cx, (2 * y0 + dy) / 2.0E0 AS cy, (2 * z0 + dz) / 2.0E0 AS cz,
  CAST(CASE WHEN k % 97 = 0 THEN 0 ELSE 40 * p_size END AS BIGINT) AS point_count, (40 + k % 60) / 100.0E0 AS confidence
FROM (
  SELECT k, s, p_size, (h2 * 13) % 50000 AS x0, (h3 * 17) % 30000 AS y0, (h1 * 3) % 9000 AS z0,
    CASE s WHEN 0 THEN 500 + h1 % 8000 WHEN 1 THEN 500 + h1 % 9000 WHEN 2 THEN 40 + h1 % 600 WHEN 3 THEN 50 + h1 % 3000 WHEN 4 THEN 300 + h1 % 2000 WHEN 5 THEN 500 + h1 % 4000 ELSE 50 + h1 % 500 END AS dx,
    CASE s WHEN 0 THEN 100 + h2 % 300 WHEN 1 THEN 500 + h2 % 7000 WHEN 2 THEN 40 + h1 % 600 WHEN 3 THEN 50 + h2 % 1500 WHEN 4 THEN 100 + h2 % 800 WHEN 5 THEN 500 + h2 % 2000 ELSE 50 + h2 % 250 END AS dy,
    CASE s WHEN 0 THEN 60 + h3 % 4000 WHEN 1 THEN 50 + h3 % 250 WHEN 2 THEN 100 + h3 % 6000 WHEN 3 THEN 50 + h3 % 3000 WHEN 4 THEN 300 + h3 % 2400 WHEN 5 THEN 300 + h3 % 3000 ELSE 50 + h3 % 300 END AS dz
  FROM ({_H}) h) d"""

POINTS = """
SELECT k AS point_id, CAST(u AS INT) AS surface, x / 1000.0E0 AS x, y / 1000.0E0 AS y, z / 1000.0E0 AS z
FROM (
  SELECT k, u,
    CASE WHEN u IN (0, 1, 4) THEN (k * 7919) % 8000 WHEN u = 2 THEN (k * 31) % 5 WHEN u = 3 THEN 8000 + (k * 31) % 5 ELSE (k * 104729) % 8000 END AS x,
    CASE u WHEN 0 THEN (k * 31) % 5 WHEN 1 THEN 6000 + (k * 31) % 5 WHEN 4 THEN (k * 104729) % 6000 WHEN 5 THEN (k * 1299709) % 6000 ELSE (k * 7919) % 6000 END AS y,
    CASE u WHEN 4 THEN (CASE WHEN k % 4 >= 2 THEN 3000 ELSE 0 END) + (k * 31) % 5 WHEN 5 THEN (k * 15485863) % 6000 ELSE (k * 1299709) % 6000 END AS z
  FROM (SELECT o_orderkey AS k, o_orderkey % 6 AS u FROM orders) o) p"""

DESIGN = """
SELECT concat('g-', k) AS global_id, shape AS ifc_class, concat('element ', k) AS name, k AS design_k,
  cx + CASE k % 4 WHEN 0 THEN 5.0E0 WHEN 1 THEN 60.0E0 WHEN 2 THEN 400.0E0 ELSE 0.0E0 END AS dx, cy AS dy, cz AS dz
FROM segments_v WHERE k % 10 < 8"""

AUDIT = "SELECT event_id, user_id AS session_id, event_type, ts, value, props AS detail FROM events"

STATIONS = """
SELECT n_nationkey AS station_index, n_name AS source_file,
  CASE WHEN n_nationkey % 4 = 0 THEN 1.5E0 ELSE (7 * n_nationkey) % 60 + 0.5E0 END AS rmse_mm,
  CASE WHEN n_nationkey % 4 = 0 THEN 0.95E0 ELSE (50 + (13 * n_nationkey) % 50) / 100.0E0 END AS inlier_ratio
FROM nation"""

LABELS = "SELECT doc_id AS point_id, quality AS y_true, toxic AS y_pred FROM labels"

#: View, its SQL and the tables that it reads.
VIEWS = {"segments_v": (SEGMENTS, ["part"]), "points_v": (POINTS, ["orders"]), "design_v": (DESIGN, ["segments_v"]), "audit_v": (AUDIT, ["events"]), "stations_v": (STATIONS, ["nation"]), "labels_v": (LABELS, ["labels"])}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view by name, or a driver table."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql, needs = VIEWS[name]
    for n in needs:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}")
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in needs})


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the views that it reads before it, as common table expressions."""
    order = [n for n in VIEWS if n in names or n == "segments_v" and "design_v" in names]
    own = ",\n".join(f"{n} AS ({VIEWS[n][0]})" for n in order)
    sql = sql.strip()
    if not own:
        return sql
    if sql.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {own},\n{sql[14:].strip()}"
    return f"WITH {own},\n{sql[4:].strip()}" if sql.upper().startswith("WITH ") else f"WITH {own}\n{sql}"
