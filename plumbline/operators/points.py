"""Aggregates over points (point_id, x, y, z in metres): cells, profiles, frames, neighbours."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored


def cell(c: str, size: float, origin: float = 0.0) -> Column:
    return F.floor((F.col(c) - origin) / size)


def voxels(points: DataFrame, size: float = 0.5) -> DataFrame:
    """The mean point and number of points of each cubic cell; sums are combined before the shuffle."""
    cells = [cell(c, size).alias(f"v{c}") for c in "xyz"]
    return points.groupBy(*cells).agg(F.count("*").alias("n"), *[F.bround(F.avg(c), 6).alias(f"mean_{c}") for c in "xyz"])


def first_points(points: DataFrame, size: float = 0.5) -> DataFrame:
    """The point with the smallest id of each cell, by its exact cell."""
    return points.groupBy(*[cell(c, size).alias(f"v{c}") for c in "xyz"]).agg(F.min_by(F.struct("point_id", "x", "y", "z"), "point_id").alias("p")).select("p.*")


def blocks(points: DataFrame, size: float = 2.0) -> DataFrame:
    """Points in each block, by one key made of the block's coordinates."""
    b = [F.floor(F.col(c) / size) for c in "xyz"]
    key = F.shiftleft(b[0], 40).bitwiseXOR(F.shiftleft(b[1], 20)).bitwiseXOR(b[2])
    return points.groupBy(key.alias("block")).agg(F.count("*").alias("n"), F.min("point_id").alias("first_point"))


def in_box(points: DataFrame, low: tuple, high: tuple, padding: float = 0.15, stride: int = 1) -> DataFrame:
    """Points in a widened box, every stride-th by id; the box is a filter that reaches the scan."""
    inside = points
    for c, a, b in zip("xyz", low, high, strict=True):
        inside = inside.filter((F.col(c) >= a - padding) & (F.col(c) <= b + padding))
    return inside if stride == 1 else inside.filter(F.pmod("point_id", F.lit(stride)) == 0)


def slab(points: DataFrame, elevation: float, thickness: float) -> DataFrame:
    """x and y of the points of a horizontal slice, both ends included."""
    return points.filter(F.col("z").between(elevation - thickness / 2, elevation + thickness / 2)).select("point_id", "x", "y")


def profile(points: DataFrame, axis: str = "z", size: float = 0.08) -> DataFrame:
    """Number of points by height bin."""
    return points.groupBy(cell(axis, size).alias("bin")).agg(F.count("*").alias("n"))


def storeys(points: DataFrame, size: float = 0.08, prominence: float = 0.10, apart: float = 2.2) -> list[float]:
    """Heights of storeys: peaks of the smoothed height profile. Spark counts; the profile has a row for each bin only."""
    rows = {r["bin"]: r["n"] for r in profile(points, "z", size).collect()}
    if not rows:
        return []
    first, last = min(rows), max(rows)
    n = [rows.get(b, 0) for b in range(first - 2, last + 3)]
    kernel = [1, 4, 6, 4, 1]
    smooth = [sum(k * (n[i + j - 2] if 0 <= i + j - 2 < len(n) else 0) for j, k in enumerate(kernel)) / 16 for i in range(len(n))]
    most = max(smooth)
    peaks = [i for i in range(1, len(n) - 1) if smooth[i] > smooth[i - 1] and smooth[i] >= smooth[i + 1] and _prominence(smooth, i) >= prominence * most]
    kept: list[int] = []
    for i in sorted(peaks, key=lambda i: (-smooth[i], i)):
        if all(abs(i - j) * size >= apart for j in kept):
            kept.append(i)
    return sorted(round((first - 2 + i + 0.5) * size, 6) for i in kept)


def _prominence(y: list[float], i: int) -> float:
    sides = []
    for step in (-1, 1):
        low, j = y[i], i
        while 0 <= j < len(y) and y[j] <= y[i]:
            low, j = min(low, y[j]), j + step
        sides.append(low)
    return y[i] - max(sides)


def column_cells(points: DataFrame, size: float = 0.30, least_points: int = 40, least_span: float = 0.5, height: float = 6.0) -> DataFrame:
    """Cells of the floor plan with enough points over enough of the height."""
    return points.groupBy(cell("x", size).alias("gx"), cell("y", size).alias("gy")).agg(F.count("*").alias("n"), F.bround(F.max("z") - F.min("z"), 6).alias("span")).filter((F.col("n") >= least_points) & (F.col("span") >= least_span * height))


def robust_extents(points: DataFrame, by: str = "surface") -> DataFrame:
    """Fifth to ninety-fifth percentile along each axis of a group, its points, and its covariance sums for eigenvectors."""
    spans = []
    for c in "xyz":
        q = F.percentile(c, F.array(F.lit(0.05), F.lit(0.95)))
        spans += [F.bround(q[0], 6).alias(f"p5_{c}"), F.bround(q[1], 6).alias(f"p95_{c}")]
    return points.groupBy(by).agg(F.count("*").alias("n"), *spans)


def covariances(points: DataFrame, by: str = "surface") -> DataFrame:
    """The six sample covariances of a group, from which the 3x3 eigenproblem follows."""
    return points.groupBy(by).agg(*[F.bround(F.covar_samp(a, b), 4).alias(f"c{a}{b}") for i, a in enumerate("xyz") for b in "xyz"[i:]])


def nearest_distances(points: DataFrame, k: int, key: str = "point_id", occupancy: float | None = None) -> DataFrame:
    """key and distances: those to the k nearest other points, nearest first; fewer where the cloud has fewer. Exact at any density.

    A point looks at its cell and the 26 around it. Its k-th distance is final if it isn't longer than a cell, as all nearer
    points are among these; the others look again with cells twice as wide. Cells begin so small that an occupied one holds about
    `occupancy` points, so a dense part makes no more pairs than a sparse one. Points with a null coordinate take no part.
    """
    own = points.select(F.col(key).alias("id"), "x", "y", "z").dropna(subset=["x", "y", "z"])
    n, *ends = own.agg(F.count("*"), *[f(c) for c in "xyz" for f in (F.min, F.max)]).first()
    occupancy = occupancy or max(3.0, k / 2)
    if not n:
        return own.select(F.col("id").alias(key), F.array().cast("array<double>").alias("distances"))
    span = max(b - a for a, b in zip(ends[::2], ends[1::2], strict=True))
    low = dict(zip("xyz", ends[::2], strict=True))
    size = max(span, 1e-9)
    while size > span / (1 << 18):  # halve while cells are crowded; one grouped count each
        cells = own.groupBy(*[cell(c, size / 2, low[c]) for c in "xyz"]).count().count()
        size /= 2
        if n / cells <= occupancy:
            break
    # Points of one place share a cell of any width, so each place is one row with its number of points.
    places = stored(own.groupBy("x", "y", "z").agg(F.count("*").alias("m")), "places")
    several = places.agg(F.max("m")).first()[0] > 1
    todo, done = places, None
    while True:
        at = lambda df, s=size: df.withColumns({f"c{c}": cell(c, s, low[c]) for c in "xyz"})
        shift = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"s{c}") for c, v in zip("xyz", t, strict=True)]) for t in itertools.product((-1, 0, 1), repeat=3)]))
        mine = at(todo).withColumn("s", shift).select("x", "y", "z", "m", *[(F.col(f"c{c}") + F.col(f"s.s{c}")).alias(f"c{c}") for c in "xyz"])
        near = at(places).select(F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"), F.col("m").alias("om"), "cx", "cy", "cz")
        d = F.sqrt(sum((F.col(c) - F.col(f"o{c}")) ** 2 for c in "xyz"))
        # The point itself is one of its place's; of the others no more than k count.
        if several:
            all_ = F.flatten(F.collect_list(F.array_repeat(d, F.least(F.lit(k), F.when(d == 0, F.col("om") - 1).otherwise(F.col("om"))).cast("int"))))
        else:
            all_ = F.collect_list(F.when(d > 0, d))
        # A distance of more than a cell is final for nobody, except in the last round.
        found = mine.join(near, ["cx", "cy", "cz"]).filter(F.lit(size >= span) | (d <= size)).groupBy("x", "y", "z", "m").agg(F.slice(F.array_sort(all_), 1, k).alias("distances"))
        whole = F.lit(size >= span) | ((F.size("distances") >= k) & (F.element_at("distances", -1) <= size))
        round_ = stored(found.withColumn("whole", whole), "nearest")
        ready = round_.filter("whole").select("x", "y", "z", "distances")
        done = ready if done is None else done.unionByName(ready)
        todo = round_.filter("NOT whole").select("x", "y", "z", "m")
        if size >= span or todo.isEmpty():
            return own.join(done, ["x", "y", "z"]).select(F.col("id").alias(key), "distances")
        size *= 2


def outliers(points: DataFrame, k: int | None = None, ratio: float = 2.0) -> DataFrame:
    """Points whose mean distance to their k nearest others exceeds mean + ratio * deviation over all points.

    k is a fiftieth of the points, 6 to 20, if it isn't given. A lone point has distance 0.
    """
    if k is None:
        k = min(20, max(6, points.count() // 50))
    own = nearest_distances(points, k).withColumn("d", F.coalesce(F.aggregate("distances", F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("distances"), F.lit(0)), F.lit(0.0)))
    own = stored(own.select("point_id", "d"), "mean_distances")
    limits = own.agg(F.avg("d").alias("mu"), F.stddev_pop("d").alias("sigma"))
    return own.crossJoin(F.broadcast(limits)).select("point_id", F.bround("d", 6).alias("mean_distance"), (F.col("d") > F.col("mu") + ratio * F.col("sigma")).alias("outlier"))


def multi_scale_radii(points: DataFrame) -> DataFrame:
    """Median distance to the nearest other point, and the local, middle and global radius that follow from it, in metres."""
    d = nearest_distances(points, 1).select(F.element_at("distances", 1).alias("d")).filter("d > 1e-6")
    clip = lambda c, a, b: F.greatest(a, F.least(c, b))
    m = d.agg(clip(F.coalesce(F.median("d"), F.lit(0.03)), F.lit(0.005), F.lit(1.0)).alias("spacing"))
    m = m.withColumn("local", clip(F.col("spacing") * 2.5, F.lit(0.02), F.lit(3.0)))
    m = m.withColumn("middle", clip(F.col("spacing") * 8, F.col("local") * 1.5, F.lit(8.0)))
    return m.withColumn("whole", clip(F.col("spacing") * 25, F.col("middle") * 1.5, F.lit(25.0)))


def chunks(points: DataFrame, size: float = 2.0, overlap: float = 0.25) -> DataFrame:
    """Points of each overlapping square chunk of the plan: a point goes to every chunk whose halo holds it."""
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - overlap) / size), F.floor((F.col(c) + overlap) / size)))
    return points.withColumn("chunk_x", span("x")).withColumn("chunk_y", span("y"))


def plane_sigma(points: DataFrame, by: str, normal: dict[int, tuple[float, float, float, float]]) -> DataFrame:
    """Root mean square distance in mm of each group's points from a plane (a, b, c, d) of unit normal."""
    whole = None
    for g, (a, b, c, d) in normal.items():
        e = F.col("x") * a + F.col("y") * b + F.col("z") * c + d
        whole = F.when(F.col(by) == g, e) if whole is None else whole.when(F.col(by) == g, e)
    return points.withColumn("e", whole).filter("e IS NOT NULL").groupBy(by).agg(F.bround(F.sqrt(F.avg(F.col("e") * F.col("e"))) * 1000, 4).alias("sigma_mm"))


def dominant_orientation(segments: DataFrame, bins: int = 18) -> DataFrame:
    """Bins of direction over [0, 180) by weight (points), of vertical planes whose direction is that of their longer side."""
    angle = F.when(F.col("max_x") - F.col("min_x") >= F.col("max_y") - F.col("min_y"), F.lit(0.0)).otherwise(F.lit(90.0))
    own = segments.filter("shape = 'plane_vertical'").withColumn("bin", F.floor(angle / (180.0 / bins)))
    return own.groupBy("bin").agg(F.sum("point_count").alias("weight"), F.count("*").alias("planes"))


def unit_scores(points: DataFrame) -> DataFrame:
    """Which unit the cloud's size speaks for: the diagonal and the height in the range of buildings in metres, millimetres, feet."""
    size = points.agg(*[(F.max(c) - F.min(c)).alias(c) for c in "xyz"]).withColumn("diagonal", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2))
    ranges = (("m", 1.0, 2000.0, 0.75), ("mm", 1e3, 2e6, 0.5), ("ft", 3.0, 6500.0, 0.6))
    options = F.array(*(F.struct(F.lit(u).alias("unit"), F.when(F.col("diagonal").between(a, b), F.lit(s)).otherwise(F.lit(0.0)).alias("score")) for u, a, b, s in ranges))
    return size.select(F.bround("diagonal", 6).alias("diagonal"), F.explode(options).alias("o")).select("diagonal", "o.unit", "o.score")


def circle(n: int = 12) -> list[tuple[float, float]]:
    return [(math.cos(2 * math.pi * i / n), math.sin(2 * math.pi * i / n)) for i in range(n)]
