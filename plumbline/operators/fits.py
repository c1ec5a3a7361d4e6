"""Geometric fits from sums: Spark adds up what a fit needs, and only those sums reach a solver, so groups have no size limit."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spatial


def _sums(points: DataFrame, by: list[str]) -> DataFrame:
    c = "xyz"
    return points.groupBy(*by).agg(F.count("*").cast("double").alias("n"), *[F.avg(a).alias(a) for a in c], *[F.covar_pop(a, b).alias(a + b) for i, a in enumerate(c) for b in c[i:]])


def _matrices(pdf: pd.DataFrame) -> np.ndarray:
    m = pdf[["xx", "xy", "xz", "xy", "yy", "yz", "xz", "yz", "zz"]].to_numpy(float)
    return m.reshape(-1, 3, 3)


def eigen(points: DataFrame, by: str) -> DataFrame:
    """Centre, eigenvalues (largest first), direction of the largest and of the smallest (a plane's normal), and linearity, planarity, sphericity.

    A group of fewer than three points has zero features. Signs: the largest component of a direction is positive.
    """
    return _features(_sums(points, [by]), by)


def _features(sums: DataFrame, by: str) -> DataFrame:
    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            w, v = np.linalg.eigh(_matrices(pdf))
            w = np.clip(w[:, ::-1], 0, None)
            out = pdf[[by, "n", "x", "y", "z"]].copy()
            for name, k in (("d", 2), ("n", 0)):
                u = v[:, :, k]
                u = u * np.sign(u[np.arange(len(u)), np.abs(u).argmax(1)])[:, None]
                for i, a in enumerate("xyz"):
                    out[f"{name}{a}"] = u[:, i]
            top = np.maximum(w[:, 0], 1e-12)
            few = pdf["n"].to_numpy() < 3
            out["l1"], out["l2"], out["l3"] = w[:, 0], w[:, 1], w[:, 2]
            out["linearity"] = np.where(few, 0, (w[:, 0] - w[:, 1]) / top)
            out["planarity"] = np.where(few, 0, (w[:, 1] - w[:, 2]) / top)
            out["sphericity"] = np.where(few, 0, w[:, 2] / top)
            yield out

    kind = sums.schema[by].dataType.simpleString()
    names = ["n", "x", "y", "z", "dx", "dy", "dz", "nx", "ny", "nz", "l1", "l2", "l3", "linearity", "planarity", "sphericity"]
    return sums.mapInPandas(solve, f"{by} {kind}, " + ", ".join(f"{n} double" for n in names))


def normals(points: DataFrame, radius: float, key: str = "point_id") -> DataFrame:
    """The normal of each point from its neighbours within the radius, upwards where it has a vertical part.

    Points of one place have one normal, so places are paired, and each neighbour counts as often as it has points. Sums are taken
    from the place itself, so nothing of their precision is lost.
    """
    xyz = ("x", "y", "z")
    places, members = spatial.classes(spatial.finite(points.select(key, *xyz), xyz), key, list(xyz))
    pairs = spatial.within_radius(places, places, radius, xyz)
    away = pairs.select(F.col(f"a.{key}").alias("class"), *[F.col(f"a.{a}").alias(f"o{a}") for a in xyz], F.col("b.copies").cast("double").alias("w"), *[(F.col(f"b.{a}") - F.col(f"a.{a}")).alias(a) for a in xyz])
    squares = [(a, b) for i, a in enumerate(xyz) for b in xyz[i:]]
    s = away.groupBy("class").agg(F.sum("w").alias("n"), *[F.first(f"o{a}").alias(f"o{a}") for a in xyz], *[F.sum(F.col("w") * F.col(a)).alias(f"s{a}") for a in xyz], *[F.sum(F.col("w") * F.col(a) * F.col(b)).alias(f"s{a}{b}") for a, b in squares])
    mean = {a: F.col(f"s{a}") / F.col("n") for a in xyz}
    sums = s.select("class", "n", *[(F.col(f"o{a}") + mean[a]).alias(a) for a in xyz], *[(F.col(f"s{a}{b}") / F.col("n") - mean[a] * mean[b]).alias(a + b) for a, b in squares])
    e = spatial.met(members, _features(sums, "class"), "class").withColumnRenamed("member", key)
    turn = F.when(F.col("nz") < 0, -1.0).otherwise(1.0)
    return e.select(key, *[(F.col(f"n{a}") * turn).alias(f"n{a}") for a in "xyz"], "n", "planarity")


def spheres(points: DataFrame, by: str) -> DataFrame:
    """Centre and radius of the sphere of least algebraic error of each group; null where points lie in a plane or are too few."""
    s = points.withColumn("q", F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    c = "xyz"
    sums = s.groupBy(by).agg(F.count("*").cast("double").alias("n"), *[F.avg(a).alias(a) for a in c], *[F.covar_pop(a, b).alias(a + b) for i, a in enumerate(c) for b in c[i:]], *[F.covar_pop(a, "q").alias(f"{a}q") for a in c], F.avg("q").alias("q"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for m, (_, r) in zip(_matrices(pdf), pdf.iterrows(), strict=True):
                # Minimises the sum of (|p|^2 - 2 c.p - k)^2: covariance * 2c = covariance with |p|^2.
                if r["n"] < 4 or np.linalg.cond(m) > 1e10:
                    rows.append((r[by], None, None, None, None))
                    continue
                centre = np.linalg.solve(m, r[["xq", "yq", "zq"]].to_numpy(float)) / 2
                mean = r[["x", "y", "z"]].to_numpy(float)
                rows.append((r[by], *centre, math.sqrt(max(0.0, r["q"] - 2 * centre @ mean + centre @ centre))))
            yield pd.DataFrame(rows, columns=[by, "cx", "cy", "cz", "radius"])

    return sums.mapInPandas(solve, f"{by} {points.schema[by].dataType.simpleString()}, cx double, cy double, cz double, radius double")


def cylinders(points: DataFrame, by: str) -> DataFrame:
    """Axis, a point on it, radius and length of the cylinder of each group: the axis is the longest direction, the circle is fitted across it."""
    e = eigen(points, by).select(by, *[F.col(a).alias(f"o{a}") for a in "xyz"], "dx", "dy", "dz")
    # Two directions across the axis.
    flat = F.abs(F.col("dz")) < 0.9
    ux, uy, uz = F.when(flat, -F.col("dy")).otherwise(F.lit(0.0)), F.when(flat, F.col("dx")).otherwise(-F.col("dz")), F.when(flat, F.lit(0.0)).otherwise(F.col("dy"))
    size = F.sqrt(ux * ux + uy * uy + uz * uz)
    e = e.withColumns({"ux": ux / size, "uy": uy / size, "uz": uz / size})
    e = e.withColumns({"vx": F.col("dy") * F.col("uz") - F.col("dz") * F.col("uy"), "vy": F.col("dz") * F.col("ux") - F.col("dx") * F.col("uz"), "vz": F.col("dx") * F.col("uy") - F.col("dy") * F.col("ux")})
    dot = lambda p: sum((F.col(a) - F.col(f"o{a}")) * F.col(f"{p}{a}") for a in "xyz")
    own = points.join(e, by).withColumns({"t": dot("d"), "u": dot("u"), "v": dot("v")}).withColumn("q", F.col("u") ** 2 + F.col("v") ** 2)
    first = [F.first(f"{p}{a}").alias(f"{p}{a}") for p in "oduv" for a in "xyz"]
    s = own.groupBy(by).agg(*first, (F.max("t") - F.min("t")).alias("length"), F.avg("u").alias("mu"), F.avg("v").alias("mv"), F.avg("q").alias("mq"), F.covar_pop("u", "u").alias("uu"), F.covar_pop("u", "v").alias("uv"), F.covar_pop("v", "v").alias("vv"), F.covar_pop("u", "q").alias("uq"), F.covar_pop("v", "q").alias("vq"))
    det = F.col("uu") * F.col("vv") - F.col("uv") ** 2
    a = F.try_divide(F.col("uq") * F.col("vv") - F.col("vq") * F.col("uv"), 2 * det)
    b = F.try_divide(F.col("vq") * F.col("uu") - F.col("uq") * F.col("uv"), 2 * det)
    s = s.withColumns({"a": a, "b": b})
    radius = F.sqrt(F.greatest(F.lit(0.0), F.col("mq") - 2 * (F.col("a") * F.col("mu") + F.col("b") * F.col("mv")) + F.col("a") ** 2 + F.col("b") ** 2))
    return s.select(by, *[(F.col(f"o{x}") + F.col("a") * F.col(f"u{x}") + F.col("b") * F.col(f"v{x}")).alias(f"p{x}") for x in "xyz"], "dx", "dy", "dz", radius.alias("radius"), "length")


def hull(p: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of points in the plane, counterclockwise, without those on an edge."""
    p = np.unique(np.asarray(p, float).reshape(-1, 2), axis=0)
    if len(p) < 3:
        return p
    sides = []
    for run in (p, p[::-1]):
        side: list[np.ndarray] = []
        for q in run:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (q[1] - side[-2][1]) - (side[-1][1] - side[-2][1]) * (q[0] - side[-2][0]) <= 0:
                side.pop()
            side.append(q)
        sides += side[:-1]
    return np.array(sides)


def hulls(points: DataFrame, by: str) -> DataFrame:
    """by, n, xs, ys: the convex hull in the plane of each group. Only the corners of each batch's hulls are shuffled."""
    kind = points.schema[by].dataType.simpleString()

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, float(x), float(y), len(g) if i == 0 else 0) for k, g in pdf.groupby(by, dropna=False) for i, (x, y) in enumerate(hull(g[["x", "y"]].to_numpy(float)))]
            yield pd.DataFrame(rows, columns=[by, "x", "y", "n"])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        h = hull(pdf[["x", "y"]].to_numpy(float))
        return pd.DataFrame({by: [pdf[by].iloc[0]], "n": [int(pdf["n"].sum())], "xs": [h[:, 0].tolist()], "ys": [h[:, 1].tolist()]})

    corners = points.select(by, "x", "y").dropna(subset=["x", "y"]).mapInPandas(partial, f"{by} {kind}, x double, y double, n long")
    return corners.groupBy(by).applyInPandas(whole, f"{by} {kind}, n long, xs array<double>, ys array<double>")


def smallest_rectangle(h: np.ndarray) -> tuple[float, float, float, float, float, float]:
    """Degrees in [0, 90), length, width, area and centre of the smallest rectangle around a hull: one of its sides lies on an edge."""
    edges = np.diff(np.vstack([h, h[:1]]), axis=0) if len(h) > 1 else np.zeros((1, 2))
    best = None
    for e in edges:
        angle = math.atan2(e[1], e[0]) % (math.pi / 2)
        c, s = math.cos(angle), math.sin(angle)
        u, v = h[:, 0] * c + h[:, 1] * s, h[:, 1] * c - h[:, 0] * s
        length, width = float(np.ptp(u)), float(np.ptp(v))
        cu, cv = (u.max() + u.min()) / 2, (v.max() + v.min()) / 2
        found = (round(length * width, 9), math.degrees(angle), length, width, float(cu * c - cv * s), float(cu * s + cv * c))
        best = found if best is None or found < best else best
    area, degrees, length, width, cx, cy = best
    return degrees, length, width, area, cx, cy


def simplified(line: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker: the points of a line that keep it within the tolerance; its ends stay."""
    line = np.asarray(line, float).reshape(-1, 2)
    keep = np.zeros(len(line), bool)
    keep[[0, -1]] = True
    todo = [(0, len(line) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, way = line[a + 1 : b] - line[a], line[b] - line[a]
        size = float(np.hypot(*way))
        off = np.abs(d[:, 0] * way[1] - d[:, 1] * way[0]) / size if size else np.hypot(d[:, 0], d[:, 1])
        i = int(off.argmax())
        if off[i] > tolerance:
            keep[a + 1 + i] = True
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return line[keep]


def rectangles(points: DataFrame, by: str) -> DataFrame:
    """The smallest rectangle in the plan around each group: angle, sides, area, centre, from the group's hull."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [smallest_rectangle(np.stack([x, y], 1)) for x, y in zip(pdf["xs"], pdf["ys"], strict=True)]
            yield pd.concat([pdf[[by]].reset_index(drop=True), pd.DataFrame(rows, columns=["degrees", "length", "width", "area", "cx", "cy"])], axis=1)

    kind = points.schema[by].dataType.simpleString()
    return hulls(points, by).mapInPandas(run, f"{by} {kind}, degrees double, length double, width double, area double, cx double, cy double")


def polygons(points: DataFrame, by: str, tolerance: float = 0.05) -> DataFrame:
    """The outline of each group: its hull, simplified, with its area by the shoelace formula and its number of corners."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for x, y in zip(pdf["xs"], pdf["ys"], strict=True):
                h = np.stack([x, y], 1)
                line = simplified(np.vstack([h, h[:1]]), tolerance)[:-1] if len(h) > 2 else h
                u, v = line[:, 0], line[:, 1]
                out.append((line[:, 0].tolist(), line[:, 1].tolist(), len(line), 0.5 * abs(float(np.dot(u, np.roll(v, -1)) - np.dot(v, np.roll(u, -1))))))
            yield pd.concat([pdf[[by, "n"]].reset_index(drop=True), pd.DataFrame(out, columns=["xs", "ys", "corners", "area"])], axis=1)

    kind = points.schema[by].dataType.simpleString()
    return hulls(points, by).mapInPandas(run, f"{by} {kind}, n long, xs array<double>, ys array<double>, corners long, area double")


def _proposed(rest: DataFrame, columns: str, hypotheses: int, seed: int) -> np.ndarray:
    """`hypotheses` groups of as many points as there are columns. A cloud with fewer points than that takes has its points drawn again."""
    k = len(columns)
    sample = rest.orderBy(F.xxhash64("point_id", F.lit(seed))).limit(k * hypotheses).select(*columns).collect()
    p = np.array([tuple(r) for r in sample], float).reshape(-1, k)
    if k <= len(p) < k * hypotheses:
        rng = np.random.default_rng(seed)
        p = p[np.concatenate([rng.choice(len(p), k, replace=False) for _ in range(hypotheses)])]
    return p[: len(p) // k * k].reshape(-1, k, k)


def _near(pdf: pd.DataFrame, normals: np.ndarray, offsets: np.ndarray, threshold: float) -> Iterator[np.ndarray]:
    """For a thousand points at a time, which of them are within the threshold of each plane or line."""
    p = pdf[list("xyz"[: normals.shape[1]])].to_numpy(float)
    for at in range(0, len(p), 1000):
        yield np.abs(p[at : at + 1000] @ normals.T - offsets) <= threshold


def _inliers(points: DataFrame, normals: np.ndarray, offsets: np.ndarray, threshold: float) -> np.ndarray:
    """Inliers of each proposal, counted in one scan; a task hands on one row for each proposal that has any."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(len(normals), np.int64)
        for pdf in batches:
            for near in _near(pdf, normals, offsets, threshold):
                n += near.sum(0)
        yield pd.DataFrame({"i": np.flatnonzero(n), "n": n[n > 0]})

    out = np.zeros(len(normals), np.int64)
    for i, n in points.mapInPandas(count, "i long, n long").groupBy("i").agg(F.sum("n")).collect():
        out[i] = n
    return out


def _left(points: DataFrame, found: list[dict], threshold: float) -> DataFrame:
    """The points that no plane or line in `found` has."""
    if not found:
        return points
    normals, offsets = np.array([x["normal"] for x in found]), np.array([x["offset"] for x in found])

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf[~np.concatenate([x.any(1) for x in _near(pdf, normals, offsets, threshold)])]

    return points.mapInPandas(keep, points.schema)


def planes(points: DataFrame, threshold: float = 0.025, hypotheses: int = 1000, most: int = 500, least_inliers: int = 50, seed: int = 42) -> list[dict]:
    """Planes by random sample consensus, densest first: unit normal, offset (normal . p = offset) and inliers.

    The driver proposes planes through hashed samples of points; one scan counts the inliers of all proposals; the best is
    refined by its inliers' covariances, which Spark sums; its points go, and the next round looks at the rest. The driver
    holds three times `hypotheses` points.
    """
    flat, found = points.select("point_id", "x", "y", "z"), []
    for round_ in range(most):
        rest = _left(flat, found, threshold)
        p = _proposed(rest, "xyz", hypotheses, seed + round_)
        n = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0]) if len(p) else np.zeros((0, 3))
        size = np.linalg.norm(n, axis=1)
        ok = size > 1e-9
        n, p = n[ok] / size[ok, None], p[ok]
        if not len(n):
            break
        off = (n * p[:, 0]).sum(1)
        counts = _inliers(rest, n, off, threshold)
        best = int(np.argmax(counts))
        if counts[best] < least_inliers:
            break
        near = F.abs(sum(F.col(c) * float(x) for c, x in zip("xyz", n[best], strict=True)) - float(off[best])) <= threshold
        fit = eigen(rest.filter(near).select(F.lit(0).alias("g"), "x", "y", "z"), "g").first()
        a = np.array([fit["nx"], fit["ny"], fit["nz"]])
        o = float(a @ np.array([fit["x"], fit["y"], fit["z"]]))
        inliers = int(_inliers(rest, a[None], np.array([o]), threshold)[0])
        if inliers < least_inliers:
            break
        found.append({"normal": tuple(a.tolist()), "offset": o, "inliers": inliers})
    return found


def lines(points: DataFrame, threshold: float = 0.05, hypotheses: int = 300, most: int = 100, least_inliers: int = 20, seed: int = 7) -> list[dict]:
    """Lines in the plan, longest runs of inliers first found, the same way: unit normal in the plan, offset, inliers."""
    flat, found = points.select("point_id", "x", "y"), []
    for round_ in range(most):
        rest = _left(flat, found, threshold)
        p = _proposed(rest, "xy", hypotheses, seed + round_)
        d = p[:, 1] - p[:, 0] if len(p) else np.zeros((0, 2))
        size = np.linalg.norm(d, axis=1)
        ok = size > 1e-9
        n = np.stack([-d[ok, 1], d[ok, 0]], 1) / size[ok, None]
        if not len(n):
            break
        off = (n * p[ok, 0]).sum(1)
        counts = _inliers(rest, n, off, threshold)
        best = int(np.argmax(counts))
        if counts[best] < least_inliers:
            break
        found.append({"normal": tuple(n[best].tolist()), "offset": float(off[best]), "inliers": int(counts[best])})
    return found


def rigid(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Rotation, shift and root mean square error that move (sx, sy, sz) to (tx, ty, tz); Spark sums, the driver solves 3 x 3."""
    mean = [F.avg(f"{p}{a}").alias(f"{p}{a}") for p in "st" for a in "xyz"]
    cross = [F.covar_pop(f"s{a}", f"t{b}").alias(f"c{a}{b}") for a in "xyz" for b in "xyz"]
    square = [F.var_pop(f"{p}{a}").alias(f"v{p}{a}") for p in "st" for a in "xyz"]
    r = pairs.agg(*mean, *cross, *square).first()
    h = np.array([[r[f"c{a}{b}"] for b in "xyz"] for a in "xyz"], float)
    u, s, vt = np.linalg.svd(h)
    d = np.sign(np.linalg.det(vt.T @ u.T)) or 1.0
    rot = vt.T @ np.diag([1, 1, d]) @ u.T
    shift = np.array([r[f"t{a}"] for a in "xyz"]) - rot @ np.array([r[f"s{a}"] for a in "xyz"])
    error = sum(r[f"v{p}{a}"] for p in "st" for a in "xyz") - 2 * (s[0] + s[1] + d * s[2])
    return rot, shift, math.sqrt(max(0.0, error))


def icp(source: DataFrame, target: DataFrame, radius: float, rounds: int = 15, least_change: float = 1e-6) -> tuple[np.ndarray, np.ndarray, float]:
    """Registers source to target (point_id, x, y, z): nearest pairs within the radius by grid join, a rigid fit, again until it settles."""
    rot, shift, before = np.eye(3), np.zeros(3), math.inf
    right = target.select(F.col("point_id").alias("other"), "x", "y", "z")
    error = math.inf
    for _ in range(rounds):
        moved = source.select("point_id", *[sum((F.col(c) * float(rot[i, j]) for j, c in enumerate("xyz")), F.lit(float(shift[i]))).alias(a) for i, a in enumerate("xyz")])
        near = spatial.within_radius(moved, right, radius, ("x", "y", "z")).groupBy(F.col("a.point_id").alias("point_id")).agg(F.min_by(F.struct("a", "b"), F.struct("distance", "b.other")).alias("m"))
        step_r, step_t, error = rigid(near.select(*[F.col(f"m.a.{a}").alias(f"s{a}") for a in "xyz"], *[F.col(f"m.b.{a}").alias(f"t{a}") for a in "xyz"]))
        rot, shift = step_r @ rot, step_r @ shift + step_t
        if abs(before - error) < least_change:
            break
        before = error
    return rot, shift, error


def stair_steps(points: DataFrame, by: str, size: float = 0.02, least_share: float = 0.3) -> DataFrame:
    """Number of treads of each group: peaks of its height profile, at least a riser of 0.08 m apart. Spark counts by height bin,
    and a group's profile has a row for each bin only."""
    bins = points.groupBy(by, F.floor(F.col("z") / size).alias("b")).agg(F.count("*").alias("n"))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["b"].min())
        y = np.zeros(int(pdf["b"].max()) - first + 1)
        y[pdf["b"].to_numpy() - first] = pdf["n"]
        y = np.convolve(y, [1, 2, 3, 2, 1], "same")
        apart, kept = round(0.08 / size), []
        for i in np.argsort(-y, kind="stable"):
            if y[i] >= least_share * y.max() and all(abs(i - j) >= apart for j in kept):
                kept.append(int(i))
        gaps = np.diff(sorted(kept)) * size
        return pd.DataFrame({by: [pdf[by].iloc[0]], "steps": [len(kept) if len(kept) > 1 and ((gaps >= 0.08 - 1e-9) & (gaps <= 0.30 + 1e-9)).all() else 0]})

    return bins.groupBy(by).applyInPandas(count, f"{by} {points.schema[by].dataType.simpleString()}, steps long")


def thickness(points: DataFrame, by: str, along: str, bins: float = 0.01, other: float = 0.2) -> DataFrame:
    """Distance of the two densest bins across a wall that are at least 5 cm apart, else the spread of the middle 80 percent, else the default."""
    counts = points.groupBy(by, F.floor(F.col(along) / bins).alias("b")).agg(F.count("*").alias("n"))
    top = counts.groupBy(by).agg(F.max(F.struct("n", (-F.col("b")).alias("b"))).alias("m"), F.sum("n").alias("all")).select(by, (-F.col("m.b")).alias("b0"), F.col("m.n").alias("n0"), "all")
    far = counts.join(top, by).filter((F.abs(F.col("b") - F.col("b0")) * bins >= 0.05) & (F.abs(F.col("b") - F.col("b0")) * bins <= 0.6)).groupBy(by).agg(F.max(F.struct("n", (-F.abs(F.col("b") - F.col("b0"))).alias("d"))).alias("m"))
    spread = points.groupBy(by).agg((F.percentile(along, 0.9) - F.percentile(along, 0.1)).alias("spread"))
    t = F.when(F.col("m.n") >= 0.3 * F.col("n0"), -F.col("m.d") * bins).when(F.col("spread") >= 0.05, F.col("spread")).otherwise(F.lit(other))
    return top.join(far, by, "left").join(spread, by).select(by, F.bround(t, 4).alias("thickness"))
