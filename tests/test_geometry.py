"""Fits, clusters and merges against plain versions and known shapes."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import exprs as E
from plumbline.operators import clusters, fits, points, spatial
from plumbline.operators.components import components

RNG = np.random.default_rng(42)


def cloud(spark, xyz, **more):
    rows = [(i, *map(float, p), *(v[i] for v in more.values())) for i, p in enumerate(xyz)]
    return spark.createDataFrame(rows, "point_id long, x double, y double, z double" + "".join(f", {k} long" for k in more))


def test_eigen_features_are_numpys(spark):
    a, b = RNG.normal(size=(200, 3)) * [5, 1, 0.1], RNG.normal(size=(100, 3)) + 7
    df = cloud(spark, np.vstack([a, b]), g=[0] * 200 + [1] * 100)
    got = {r["g"]: r for r in fits.eigen(df, "g").collect()}
    for g, p in ((0, a), (1, b)):
        w = np.linalg.eigvalsh(np.cov(p.T, bias=True))[::-1]
        assert np.allclose([got[g]["l1"], got[g]["l2"], got[g]["l3"]], w)
        assert math.isclose(got[g]["linearity"], (w[0] - w[1]) / w[0], rel_tol=1e-6)


def test_normals_of_a_plane(spark):
    x, y = RNG.uniform(0, 3, 300), RNG.uniform(0, 3, 300)
    df = cloud(spark, np.stack([x, y, 0.1 * x + RNG.normal(scale=0.001, size=300)], 1))
    want = np.array([-0.1, 0, 1]) / math.hypot(0.1, 1)
    for r in fits.normals(df, 0.8).filter("n >= 10").collect():
        assert math.degrees(math.acos(min(1, np.dot([r.nx, r.ny, r.nz], want)))) < 2


def test_sphere_and_cylinder(spark):
    u = RNG.normal(size=(400, 3))
    ball = u / np.linalg.norm(u, axis=1)[:, None] * 1.5 + [1, 2, 3]
    s = fits.spheres(cloud(spark, ball, g=[0] * 400), "g").first()
    assert np.allclose([s.cx, s.cy, s.cz, s.radius], [1, 2, 3, 1.5], atol=1e-6)
    t, a = RNG.uniform(0, 10, 600), RNG.uniform(0, 2 * math.pi, 600)
    tube = np.stack([t, 4 + 0.3 * np.cos(a), 2 + 0.3 * np.sin(a)], 1) + RNG.normal(scale=0.002, size=(600, 3))
    c = fits.cylinders(cloud(spark, tube, g=[0] * 600), "g").first()
    assert abs(c.radius - 0.3) < 0.01 and abs(c.dx) > 0.999 and abs(c.length - 10) < 0.2
    assert math.hypot(c.py - 4, c.pz - 2) < 0.05
    flat = fits.spheres(cloud(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0)], g=[0] * 3), "g").first()
    assert flat.radius is None


def test_planes_of_a_room(spark):
    n = 300
    floor = np.stack([RNG.uniform(0, 5, n), RNG.uniform(0, 4, n), RNG.normal(scale=0.003, size=n)], 1)
    wall = np.stack([RNG.normal(scale=0.003, size=n), RNG.uniform(0, 4, n), RNG.uniform(0, 3, n)], 1)
    found = fits.planes(cloud(spark, np.vstack([floor, wall, RNG.uniform(0, 3, (30, 3))])), hypotheses=40, most=2)
    axes = [tuple(np.round(np.abs(p["normal"])).astype(int)) for p in found]
    assert set(axes) == {(0, 0, 1), (1, 0, 0)} and all(p["inliers"] > 250 and abs(p["offset"]) < 0.02 for p in found)


def test_lines_of_a_plan(spark):
    t = RNG.uniform(0, 6, 200)
    df = cloud(spark, np.vstack([np.stack([t, 0 * t, 0 * t], 1), np.stack([0 * t + 6, t, 0 * t], 1)]))
    found = fits.lines(df, hypotheses=40, most=2)
    assert {tuple(np.round(np.abs(x["normal"])).astype(int)) for x in found} == {(0, 1), (1, 0)}


def test_all_planes_and_lines_are_found(spark, monkeypatch):
    from plumbline.plans import catalog

    rng = np.random.default_rng(5)
    slabs = cloud(spark, [(*rng.uniform(0, 10, 2), float(i % 8)) for i in range(8 * 60)], surface=[0] * 480)
    monkeypatch.setattr(catalog, "view", lambda *_: slabs)
    assert sorted(round(r.offset) for r in catalog.QUERIES["plane_detection"](spark, "").collect()) == list(range(8))
    rows = cloud(spark, [(rng.uniform(0, 6), float(i % 25) / 4, 1.5) for i in range(25 * 30)], surface=[0] * 750)
    monkeypatch.setattr(catalog, "view", lambda *_: rows)
    assert catalog.QUERIES["floor_plan_lines"](spark, "").count() == 25


def test_clusters_and_normals_are_those_of_the_whole_cloud(spark, monkeypatch):
    from plumbline.plans import catalog

    xyz = np.random.default_rng(6).uniform(0, 2, (240, 3))
    df = cloud(spark, xyz, surface=[i % 6 for i in range(240)])
    monkeypatch.setattr(catalog, "view", lambda *_: df)
    near = np.linalg.norm(xyz[:, None] - xyz[None], axis=2)
    got = {r.point_id: r.n for r in catalog.QUERIES["point_normals"](spark, "").collect()}
    assert len(got) == 240 and (len(set(got.values())) > 1)
    core = (near <= 0.6).sum(1) >= 8
    want = core | ((near <= 0.6) & core[None]).any(1)
    rows = [r for r in catalog.QUERIES["dbscan_clusters"](spark, "").collect() if r.cluster is not None]
    assert {r.point_id for r in rows} == set(np.flatnonzero(want))


def test_rigid_fit_and_icp(spark):
    a = math.radians(8)
    rot, shift = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]]), np.array([0.05, -0.04, 0.02])
    p = RNG.uniform(-1, 1, (120, 3))
    q = p @ rot.T + shift
    pairs = spark.createDataFrame([tuple(map(float, (*x, *y))) for x, y in zip(p, q, strict=True)], "sx double, sy double, sz double, tx double, ty double, tz double")
    r, t, error = fits.rigid(pairs)
    assert np.allclose(r, rot) and np.allclose(t, shift) and error < 1e-6
    r, t, error = fits.icp(cloud(spark, p), cloud(spark, q), 0.5, rounds=12)
    assert np.allclose(r, rot, atol=1e-3) and np.allclose(t, shift, atol=1e-3) and error < 1e-3


def test_smallest_rectangle(spark):
    a = math.radians(30)
    box = np.array([(x, y) for x in (0, 4) for y in (0, 1)]) @ np.array([[math.cos(a), math.sin(a)], [-math.sin(a), math.cos(a)]])
    r = fits.rectangles(cloud(spark, np.hstack([box, np.zeros((4, 1))]), g=[0] * 4), "g").first()
    assert math.isclose(r.area, 4, rel_tol=1e-6) and sorted([round(r.length, 6), round(r.width, 6)]) == [1, 4]


def test_stairs_and_thickness(spark):
    steps = [(RNG.uniform(0, 1), i * 0.3, i * 0.18 + RNG.normal(scale=0.002)) for i in range(6) for _ in range(60)]
    ramp = [(0, t, 0.3 * t) for t in np.linspace(0, 3, 200)]
    df = cloud(spark, steps + ramp, g=[0] * len(steps) + [1] * len(ramp))
    assert {r.g: r.steps for r in fits.stair_steps(df, "g").collect()}[0] == 6
    faces = [(RNG.uniform(0, 5), s * 0.2 + RNG.normal(scale=0.002), RNG.uniform(0, 3)) for s in (0, 1) for _ in range(300)]
    assert abs(fits.thickness(cloud(spark, faces, g=[0] * 600), "g", "y").first().thickness - 0.2) <= 0.0201


def test_storeys_of_slabs(spark):
    slabs = [(RNG.uniform(0, 5), RNG.uniform(0, 5), z + RNG.normal(scale=0.01)) for z in (0.0, 3.0, 6.0) for _ in range(400)]
    found = points.storeys(cloud(spark, slabs))
    assert len(found) == 3 and all(abs(a - b) < 0.1 for a, b in zip(found, (0, 3, 6), strict=True))
    assert points.storeys(cloud(spark, [])) == []


def plain_dbscan(p, eps, least):
    near = [[j for j in range(len(p)) if math.dist(p[i], p[j]) <= eps] for i in range(len(p))]
    core = [len(n) >= least for n in near]
    label = {}
    for i in range(len(p)):
        if core[i] and i not in label:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in label:
                    label[x] = i
                    todo += [j for j in near[x] if core[j]]
    for i in range(len(p)):
        if not core[i] and (c := [label[j] for j in near[i] if core[j]]):
            label[i] = min(c)
    return label


@pytest.mark.parametrize(("eps", "least"), [(0.3, 4), (0.5, 1)])
def test_dbscan_is_the_plain_one(spark, eps, least):
    p = np.vstack([RNG.normal(scale=0.3, size=(60, 3)), RNG.normal(scale=0.3, size=(60, 3)) + 4, RNG.uniform(-3, 7, (20, 3))]).tolist()
    got = {r.point_id: r.cluster for r in clusters.dbscan(cloud(spark, p), eps, least).collect()}
    assert got == plain_dbscan(p, eps, least)


def test_regions_stop_at_edges(spark):
    grid = [(x / 10, y / 10) for x in range(10) for y in range(10)]
    p = [(x, y, 0.0) for x, y in grid] + [(x, 0.95, y + 0.05) for x, y in grid]
    df = cloud(spark, p).withColumn("nx", F.lit(0.0)).withColumn("ny", F.when(F.col("point_id") < 100, 0.0).otherwise(1.0)).withColumn("nz", F.when(F.col("point_id") < 100, 1.0).otherwise(0.0))
    assert clusters.regions(df, 0.15, least=5).select("cluster").distinct().count() == 2


def boxes(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        low = rng.integers(0, 60, 3).astype(float)
        high = low + rng.integers(5, 30, 3)
        rows.append((k, f"s{k}", ["box", "void"][int(rng.integers(2))], *low.tolist(), *high.tolist(), *((low + high) / 2).tolist(), int(rng.integers(0, 900)), float(rng.integers(40, 99) / 100)))
    return rows, spark.createDataFrame(rows, "k long, segment_id string, shape string, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double, cx double, cy double, cz double, point_count long, confidence double")


def plain_iou(a, b):
    i = math.prod(max(0.0, min(a[6 + d], b[6 + d]) - max(a[3 + d], b[3 + d])) for d in range(3))
    va, vb = (math.prod(x[6 + d] - x[3 + d] for d in range(3)) for x in (a, b))
    return i / (va + vb - i), i / min(va, vb)


def test_suppression_is_the_greedy_one(spark):
    rows, df = boxes(spark, 150)
    kept = []
    for r in sorted(rows, key=lambda r: (-round(r[13] * math.log(max(r[12], 2)), 9), r[0])):
        if all(not ((r[2] == o[2] and plain_iou(r, o)[0] >= 0.2) or plain_iou(r, o)[1] >= 0.6) for o in kept):
            kept.append(r)
    got = {r.k for r in clusters.suppressed(df, 0.2, 0.6).collect()}
    assert got == {r[0] for r in kept} and len(got) < 150


@pytest.mark.parametrize("cell", [7.0, 4000.0])
def test_box_pairs_are_all_pairs_once(spark, cell):
    rows, df = boxes(spark, 80)
    want = sorted((a[0], b[0]) for a, b in itertools.product(rows, rows) if all(max(a[3 + d], b[3 + d]) - min(a[6 + d], b[6 + d]) <= 4 for d in range(3)))
    got = sorted((r.a.k, r.b.k) for r in spatial.box_pairs(df, df, 4.0, cell).collect())
    assert got == want


def test_radius_and_nearest(spark):
    p, q = RNG.uniform(0, 5, (70, 3)), RNG.uniform(0, 5, (60, 3))
    left, right = cloud(spark, p), cloud(spark, q).withColumnRenamed("point_id", "other")
    d = np.linalg.norm(p[:, None] - q[None], axis=2)
    got = sorted((r.a.point_id, r.b.other) for r in spatial.within_radius(left, right, 0.9, ("x", "y", "z")).collect())
    assert got == sorted(zip(*map(np.ndarray.tolist, np.nonzero(d <= 0.9)), strict=True))
    best = {r.point_id: r.other for r in spatial.nearest_within(left, right, "point_id", "other", 0.9, ("x", "y", "z")).collect()}
    assert best == {i: int(d[i].argmin()) for i in range(70) if d[i].min() <= 0.9}


def test_box_expressions(spark):
    df = spark.sql("SELECT named_struct('min_x', 0D, 'max_x', 2D, 'min_y', 0D, 'max_y', 2D, 'min_z', 0D, 'max_z', 2D) a, named_struct('min_x', 1D, 'max_x', 3D, 'min_y', 0D, 'max_y', 2D, 'min_z', 0D, 'max_z', 2D) b, named_struct('min_x', 5D, 'max_x', 5D, 'min_y', 0D, 'max_y', 2D, 'min_z', 0D, 'max_z', 2D) c")
    r = df.select(E.iou().alias("iou"), E.containment().alias("in"), E.iou("c", "c").alias("flat"), E.box_distance("a", "c").alias("far"), E.axis_angle(F.lit(-1.0), F.lit(0.0)).alias("angle")).first()
    assert (round(r.iou, 6), r["in"], r.flat, r.far, r.angle) == (0.333333, 0.5, 0.0, 3.0, 0.0)
    with pytest.raises(Exception, match="negative"):
        spark.range(1).select(E.loa_tier(F.lit(-1.0))).collect()


def test_components_of_a_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (102, 101)], "a long, b long")
    assert {r.node: r.root for r in components(df).collect()} == {i: 0 for i in range(41)} | {101: 101, 102: 101}
