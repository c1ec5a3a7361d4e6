"""Parametric elements from the points of an instance: Spark adds up what a fit needs, its frame is solved from sums, extents are aggregates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fits
from .joins import hot_join

#: Directions over a quarter turn in which a column's cross-section is measured, both ends included.
DIRECTIONS = 45


def measured(points: DataFrame, by: str) -> DataFrame:
    """One row for each instance: n, centre x, y, z, axis dx, dy, dz (longest), normal nx, ny, nz (shortest), extents along axis (u0, u1),
    across (v0, v1) and along the normal (w0, w1), height (z0, z1), and median, mean and mean square distance from the axis.

    Points with a null coordinate take no part. An instance may hold any share of the points: the frames of hot ones are broadcast.
    """
    own = points.select(by, "x", "y", "z").dropna()
    frames = fits.eigen(own, by).select(F.col(by), F.col("n").alias("m"), *[F.col(c).alias(f"c{c}") for c in "xyz"], "dx", "dy", "dz", "nx", "ny", "nz", "l1", "l2", "l3")
    put = hot_join(own, frames.withColumn("size", F.col("m").cast("long")), by, "size", own.count(), "inner")
    e = {c: F.col(c) - F.col(f"c{c}") for c in "xyz"}
    u = sum(e[c] * F.col(f"d{c}") for c in "xyz")
    w = sum(e[c] * F.col(f"n{c}") for c in "xyz")
    v = e["x"] * (F.col("ny") * F.col("dz") - F.col("nz") * F.col("dy")) + e["y"] * (F.col("nz") * F.col("dx") - F.col("nx") * F.col("dz")) + e["z"] * (F.col("nx") * F.col("dy") - F.col("ny") * F.col("dx"))
    put = put.withColumns({"u": u, "v": v, "w": w}).withColumn("r", F.sqrt(F.col("v") ** 2 + F.col("w") ** 2))
    same = ["m", "cx", "cy", "cz", "dx", "dy", "dz", "nx", "ny", "nz", "l1", "l2", "l3"]
    sums = [F.first(c).alias(c) for c in same] + [f(c).alias(f"{c}{i}") for c in "uvwz" for i, f in enumerate((F.min, F.max))]
    return put.groupBy(by).agg(*sums, F.median("r").alias("r_median"), F.avg("r").alias("r_mean"), F.avg(F.col("r") ** 2).alias("r_square")).withColumn("n", F.col("m").cast("long")).drop("m")


def _ends() -> tuple[list[Column], list[Column], Column]:
    """Begin and end of the axis, turned so that x, else y, grows; and whether it was turned."""
    a, b = ([F.col(f"c{c}") + F.col(u) * F.col(f"d{c}") for c in "xyz"] for u in ("u0", "u1"))
    turn = (a[0] > b[0]) | ((F.abs(a[0] - b[0]) < 1e-4) & (a[1] > b[1]))
    swap = lambda p, q: [F.when(turn, y).otherwise(x) for x, y in zip(p, q, strict=True)]
    return swap(a, b), swap(b, a), turn


def _named(columns: list[Column], name: str) -> list[Column]:
    return [F.bround(c, 4).alias(f"{name}_{a}") for c, a in zip(columns, "xyz", strict=True)]


def pipes(m: DataFrame, by: str) -> DataFrame:
    """Axis, diameter, slope and confidence of instances (see measured()) of 15 points, 0.1 m and a radius of 0.01 to 0.6 m."""
    start, end, _ = _ends()
    radius, length = F.col("r_median"), F.col("u1") - F.col("u0")
    rmse = F.sqrt(F.greatest(F.lit(0.0), F.col("r_square") - 2 * radius * F.col("r_mean") + radius * radius))
    flat = F.sqrt((end[0] - start[0]) ** 2 + (end[1] - start[1]) ** 2)
    fit = F.greatest(F.lit(0.0), 1 - rmse / F.greatest(radius, F.lit(1e-3)))
    sure = F.greatest(F.lit(0.3), F.least(F.lit(0.98), 0.6 * fit + 0.4 * F.least(F.lit(1.0), F.col("n") / 50)))
    good = m.filter((F.col("n") >= 15) & (length >= 0.10) & radius.between(0.01, 0.60))
    return good.select(by, "n", *_named(start, "start"), *_named(end, "end"), F.bround(2 * radius, 4).alias("diameter_m"), F.bround(length, 4).alias("length_m"), F.bround(F.abs(end[2] - start[2]) / F.greatest(flat, F.lit(1e-4)), 4).alias("slope"), F.bround(rmse, 4).alias("rmse_m"), F.bround(sure, 4).alias("confidence"))


def _boxed(m: DataFrame, by: str, least: int, good: Column, sure: float, across: tuple[str, str]) -> DataFrame:
    axis = [F.col(f"c{c}") + F.col("u0") * F.col(f"d{c}") for c in "xyz"], [F.col(f"c{c}") + F.col("u1") * F.col(f"d{c}") for c in "xyz"]
    sized = m.withColumns({"length_m": F.col("u1") - F.col("u0"), across[0]: F.col("v1") - F.col("v0"), across[1]: F.col("w1") - F.col("w0")})
    return sized.filter((F.col("n") >= least) & good).select(by, "n", *_named(axis[0], "start"), *_named(axis[1], "end"), *[F.bround(c, 4).alias(c) for c in ("length_m", *across)], F.lit(sure).alias("confidence"))


def ducts(m: DataFrame, by: str) -> DataFrame:
    """Axis, width and height of instances of 20 points, 0.2 m long and 0.08 m across."""
    return _boxed(m, by, 20, (F.col("length_m") >= 0.20) & (F.col("width_m") >= 0.08) & (F.col("height_m") >= 0.08), 0.85, ("width_m", "height_m"))


def cable_trays(m: DataFrame, by: str) -> DataFrame:
    """Axis, width and depth of instances of 15 points, 0.2 m long and 0.05 m wide."""
    return _boxed(m, by, 15, (F.col("length_m") >= 0.20) & (F.col("width_m") >= 0.05), 0.82, ("width_m", "depth_m"))


def valves(m: DataFrame, by: str, pipe: str | None = None) -> DataFrame:
    """Centre and sizes, largest first, of instances of 10 points; surer where column `pipe` names a pipe."""
    sizes = F.reverse(F.array_sort(F.array(*[F.col(f"{c}1") - F.col(f"{c}0") for c in "uvw"])))
    sure = F.lit(0.65) if pipe is None else F.when(F.col(pipe).isNotNull(), 0.80).otherwise(0.65)
    return m.filter("n >= 10").select(by, "n", *_named([F.col(f"c{c}") for c in "xyz"], "centre"), *[F.bround(sizes[i], 4).alias(c) for i, c in enumerate(("length_m", "width_m", "height_m"))], sure.alias("confidence"))


def oriented_boxes(m: DataFrame, by: str) -> DataFrame:
    """The box along an instance's own axes: centre, half sizes and the axes themselves."""
    mid = [(F.col(f"{c}0") + F.col(f"{c}1")) / 2 for c in "uvw"]
    v = [F.col("ny") * F.col("dz") - F.col("nz") * F.col("dy"), F.col("nz") * F.col("dx") - F.col("nx") * F.col("dz"), F.col("nx") * F.col("dy") - F.col("ny") * F.col("dx")]
    centre = [F.col(f"c{c}") + mid[0] * F.col(f"d{c}") + mid[1] * v[i] + mid[2] * F.col(f"n{c}") for i, c in enumerate("xyz")]
    return m.select(by, "n", *_named(centre, "centre"), *[F.bround((F.col(f"{c}1") - F.col(f"{c}0")) / 2, 4).alias(f"half_{c}") for c in "uvw"], *[F.bround(f"d{c}", 4).alias(f"axis_{c}") for c in "xyz"], *[F.bround(f"n{c}", 4).alias(f"normal_{c}") for c in "xyz"])


def patch_features(m: DataFrame, by: str) -> DataFrame:
    """Planarity, linearity, scattering, curvature, verticality, horizontality and cylindricality of instances of three points."""
    e2, e1, e0 = (F.greatest(F.col(c), F.lit(1e-12)) for c in ("l1", "l2", "l3"))
    steep = F.least(F.lit(1.0), F.abs("nz"))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("r_square") - F.col("r_mean") ** 2))
    round_ = F.when((F.col("n") > 4) & (F.col("r_mean") > 1e-6), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 2 * spread / F.col("r_mean")))).otherwise(0.0)
    values = {"planarity": (e1 - e0) / e2, "linearity": (e2 - e1) / e2, "scattering": e0 / e2, "curvature": e0 / (e0 + e1 + e2), "verticality": 1 - steep, "horizontality": steep, "cylindricality": round_}
    return m.filter("n >= 3").select(by, "n", *[F.bround(v, 4).alias(k) for k, v in values.items()])


def _thickness(counts: np.ndarray, low: float, high: float, spread: float, default: float) -> tuple[float, str]:
    """From 30 bins across a wall: the distance of its outermost faces, else the spread, else what is bounded by the default."""
    least = max(counts.mean(), 2)
    peaks = []
    for i in range(1, len(counts) - 1):
        j = i
        while j < len(counts) - 1 and counts[j] == counts[i]:
            j += 1
        if counts[i] > counts[i - 1] and counts[j] < counts[i]:
            sides = []
            for run in (counts[i::-1], counts[i:]):
                above = np.flatnonzero(run > counts[i])
                sides.append(run[: above[0]].min() if len(above) else run.min())
            if counts[i] - max(sides) >= least:
                peaks.append((i + j - 1) // 2)
    kept: list[int] = []
    for i in sorted(peaks, key=lambda i: (-counts[i], -i)):
        if all(abs(i - k) >= 5 for k in kept):
            kept.append(i)
    if len(kept) > 1:
        found = (max(kept) - min(kept)) * (high - low) / len(counts)
        if 0.05 <= found <= 0.80:
            return found, "faces"
    if 0.08 <= spread <= 0.60:
        return spread, "spread"
    return max(0.10, min(high - low, default)), "bounded"


def walls(points: DataFrame, by: str, default_m: float = 0.20) -> DataFrame:
    """Centre line, length, height, thickness, direction and plane of instances of 30 points, 0.2 m long and 0.4 m high.

    The plane is that of least variance with its normal laid flat. Thickness comes from 30 bins across the wall, counted by Spark.
    """
    own = points.select(by, "x", "y", "z").dropna()
    frames = fits.eigen(own, by).filter("n >= 30")
    size = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2)
    frames = frames.select(by, F.col("n").cast("long").alias("n"), F.when(size > 1e-6, F.col("nx") / size).otherwise(1.0).alias("a"), F.when(size > 1e-6, F.col("ny") / size).otherwise(0.0).alias("b"), F.col("x").alias("mx"), F.col("y").alias("my"))
    frames = frames.withColumn("m", F.col("n")).withColumn("d", -(F.col("mx") * F.col("a") + F.col("my") * F.col("b")))
    total = own.count()
    put = hot_join(own, frames.drop("n"), by, "m", total, "inner").withColumns({"p": F.col("x") * F.col("a") + F.col("y") * F.col("b"), "l": F.col("y") * F.col("a") - F.col("x") * F.col("b")})
    q = F.percentile("p", F.array(F.lit(0.05), F.lit(0.95)))
    ends = put.groupBy(by).agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("a", "b", "d")], F.min("l").alias("l0"), F.max("l").alias("l1"), F.min("p").alias("p0"), F.max("p").alias("p1"), F.min("z").alias("z0"), F.max("z").alias("z1"), (q[1] - q[0]).alias("spread"), F.sqrt(F.avg((F.col("p") + F.col("d")) ** 2)).alias("rmse"))
    good = ends.filter("l1 - l0 >= 0.20 AND z1 - z0 >= 0.40")
    bins = hot_join(own, good.select(by, "a", "b", "p0", "p1", "n"), by, "n", total, "inner")
    at = F.least(F.lit(29), F.floor((F.col("x") * F.col("a") + F.col("y") * F.col("b") - F.col("p0")) / F.greatest(F.col("p1") - F.col("p0"), F.lit(1e-12)) * 30)).cast("int")
    counted = bins.groupBy(by, at.alias("bin")).agg(F.count("*").alias("k")).groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("bin", "k"))).alias("bins"))
    kind = points.schema[by].dataType.simpleString()

    def thick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [_thickness(np.array([dict(x).get(i, 0) for i in range(30)], float), lo, hi, s, default_m) for x, lo, hi, s in zip(pdf["bins"], pdf["p0"], pdf["p1"], pdf["spread"], strict=True)]
            yield pd.concat([pdf[[by]].reset_index(drop=True), pd.DataFrame(rows, columns=["thickness_m", "method"])], axis=1)

    wide = good.join(counted, by).select(by, "bins", "p0", "p1", "spread").mapInPandas(thick, f"{by} {kind}, thickness_m double, method string")
    line = lambda l: [-F.col("b") * F.col(l) - F.col("a") * F.col("d"), F.col("a") * F.col(l) - F.col("b") * F.col("d"), (F.col("z0") + F.col("z1")) / 2]
    degrees = F.pmod(F.degrees(F.atan2(F.col("a"), -F.col("b"))), F.lit(180.0))
    return good.join(wide, by).select(by, "n", *_named(line("l0"), "start"), *_named(line("l1"), "end"), F.bround(F.col("l1") - F.col("l0"), 4).alias("length_m"), F.bround(F.col("z1") - F.col("z0"), 4).alias("height_m"), F.bround("thickness_m", 4).alias("thickness_m"), "method", F.bround(degrees, 4).alias("degrees"), F.bround("z0", 4).alias("base_m"), F.bround("rmse", 4).alias("rmse_m"))


def columns(points: DataFrame, by: str) -> DataFrame:
    """Centre, oriented cross-section, height and profile of instances of 25 points, 0.6 m high and 0.08 m across.

    Extremes in each direction are aggregates, so no point is multiplied. A profile is round if the distances from the centre vary little.
    """
    own = points.select(by, "x", "y", "z").dropna()
    angles = np.linspace(0, math.pi / 2, DIRECTIONS).tolist()
    sums = []
    for i, t in enumerate(angles):
        c, s = math.cos(t), math.sin(t)
        u, v = F.col("x") * c + F.col("y") * s, F.col("y") * c - F.col("x") * s
        sums.append(F.struct(F.min(u).alias("u0"), F.max(u).alias("u1"), F.min(v).alias("v0"), F.max(v).alias("v1"), F.lit(t).alias("t"), F.lit(i).alias("i")))
    spans = own.groupBy(by).agg(F.count("*").alias("n"), F.min("z").alias("z0"), F.max("z").alias("z1"), F.array(*sums).alias("turns"))
    area = lambda x: F.bround((x["u1"] - x["u0"]) * (x["v1"] - x["v0"]), 12)
    best = F.array_min(F.transform("turns", lambda x: F.struct(area(x).alias("area"), x["i"].alias("i"), x["u0"].alias("u0"), x["u1"].alias("u1"), x["v0"].alias("v0"), x["v1"].alias("v1"), x["t"].alias("t"))))
    sized = spans.withColumn("b", best).select(by, "n", "z0", "z1", "b.*").withColumns({"width_m": F.col("u1") - F.col("u0"), "depth_m": F.col("v1") - F.col("v0")})
    good = sized.filter("n >= 25 AND z1 - z0 >= 0.60 AND width_m >= 0.08 AND depth_m >= 0.08")
    mu, mv = (F.col("u0") + F.col("u1")) / 2, (F.col("v0") + F.col("v1")) / 2
    good = good.withColumns({"centre_x": mu * F.cos("t") - mv * F.sin("t"), "centre_y": mu * F.sin("t") + mv * F.cos("t")})
    r = F.sqrt((F.col("x") - F.col("centre_x")) ** 2 + (F.col("y") - F.col("centre_y")) ** 2)
    spread = hot_join(own, good.select(by, "centre_x", "centre_y", "n"), by, "n", own.count(), "inner").groupBy(by).agg((F.stddev_pop(r) / F.greatest(F.avg(r), F.lit(1e-6))).alias("cv"))
    even = F.least("width_m", "depth_m") / F.greatest("width_m", "depth_m")
    profile = F.when((F.col("cv") < 0.12) & (even > 0.85), "CIRCULAR").otherwise("RECTANGULAR")
    return good.join(spread, by).select(by, "n", F.bround("centre_x", 4).alias("centre_x"), F.bround("centre_y", 4).alias("centre_y"), F.bround((F.col("z0") + F.col("z1")) / 2, 4).alias("centre_z"), *[F.bround(c, 4).alias(c) for c in ("width_m", "depth_m")], F.bround(F.col("z1") - F.col("z0"), 4).alias("height_m"), F.bround(F.degrees("t"), 4).alias("degrees"), profile.alias("profile"))


def slabs(points: DataFrame, by: str, least_m: float = 0.10) -> DataFrame:
    """Plane, top, thickness and outline of instances of 20 points whose normal is upright (0.8)."""
    m = measured(points, by).filter("n >= 20 AND abs(nz) >= 0.80")
    thick = F.greatest(F.col("w1") - F.col("w0"), F.col("z1") - F.col("z0"), F.lit(least_m))
    outline = fits.polygons(points.select(by, "x", "y", "z").dropna(), by).filter("corners >= 3").select(by, "corners", "area")
    return m.join(outline, by).select(by, "n", F.bround(F.abs("nz"), 4).alias("nz"), F.bround("z1", 4).alias("top_m"), F.bround(F.col("z1") - thick, 4).alias("bottom_m"), F.bround(thick, 4).alias("thickness_m"), "corners", F.bround("area", 4).alias("area_m2"))


def cylinder_sigma(points: DataFrame, by: str, axis: DataFrame) -> DataFrame:
    """Root mean square distance in mm of each group's points from a cylinder: `axis` has by, px, py, pz, ax, ay, az (unit) and radius."""
    joined = points.join(axis, by)
    e = {c: F.col(c) - F.col(f"p{c}") for c in "xyz"}
    along = sum(e[c] * F.col(f"a{c}") for c in "xyz")
    away = F.sqrt(F.greatest(F.lit(0.0), sum(e[c] ** 2 for c in "xyz") - along**2))
    return joined.groupBy(by).agg(F.bround(F.sqrt(F.avg((away - F.col("radius")) ** 2)) * 1000, 4).alias("sigma_mm"))


def _verdict(df: DataFrame, finite: Column, rules: list[tuple[Column, str]], few: Column) -> DataFrame:
    reasons = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in rules]))
    out = df.withColumn("reasons", F.when(finite, reasons).otherwise(F.array(F.lit("not_finite"))))
    return out.withColumn("status", F.when(F.size("reasons") == 0, "ACCEPTED").when(finite & few, "REJECTED_SUPPORT").otherwise("REJECTED_GEOMETRY"))


def _finite(*names: str) -> Column:
    bad = F.lit(False)
    for c in names:
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return ~bad


def validated_walls(df: DataFrame, least: int = 25, residual_m: float = 0.10) -> DataFrame:
    """Adds reasons and status to rows with n, length_m, height_m, thickness_m and rmse_m."""
    few = F.col("n") < least
    rules = [(F.col("length_m") <= 0.15, "length"), (F.col("height_m") <= 0.30, "height"), ((F.col("thickness_m") < 0.04) | (F.col("thickness_m") > 1.20), "thickness"), (few, "support"), (F.col("rmse_m") > F.greatest(F.lit(residual_m), F.col("thickness_m") / 2 + 0.04), "residual")]
    return _verdict(df, _finite("length_m", "height_m", "thickness_m"), rules, few)


def validated_columns(df: DataFrame, least: int = 25) -> DataFrame:
    """Adds reasons and status to rows with n, width_m, depth_m and height_m."""
    few = F.col("n") < least
    return _verdict(df, _finite("width_m", "depth_m", "height_m"), [((F.col("width_m") <= 0.06) | (F.col("depth_m") <= 0.06), "cross_section"), (F.col("height_m") <= 0.40, "height"), (few, "support")], few)


def validated_slabs(df: DataFrame, least: int = 20) -> DataFrame:
    """Adds reasons and status to rows with n, corners and thickness_m."""
    few = F.col("n") < least
    rules = [(F.col("corners") < 3, "outline"), (~_finite("thickness_m") | (F.col("thickness_m") < 0.05) | (F.col("thickness_m") > 1.50), "thickness"), (few, "support")]
    return _verdict(df, F.lit(True), rules, few)


def l_junctions(walls: DataFrame, by: str, near_m: float = 0.35) -> DataFrame:
    """Pairs (a < b) of walls (start_x .. end_y) that have ends nearer than this: ends meet by cell, so it is no cross join."""
    ends = walls.select(by, F.explode(F.array(*[F.struct(F.col(f"{e}_x").alias("x"), F.col(f"{e}_y").alias("y")) for e in ("start", "end")])).alias("p")).select(by, "p.*").dropna()
    shift = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    cell = lambda c: F.floor(F.col(c) / near_m)
    left = ends.withColumn("s", F.explode(shift)).select(F.col(by).alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), (cell("x") + F.col("s.i")).alias("gx"), (cell("y") + F.col("s.j")).alias("gy"))
    right = ends.select(F.col(by).alias("b"), F.col("x").alias("bx"), F.col("y").alias("by_"), cell("x").alias("gx"), cell("y").alias("gy"))
    apart = (F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by_")) ** 2
    return left.join(right, ["gx", "gy"]).filter((F.col("a") < F.col("b")) & (apart < near_m**2)).select("a", "b").distinct()
