"""Nearest neighbours, hulls, suppression and reconstructed elements against plain versions and known shapes."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline import storage
from plumbline.operators import clusters, filters, fits, points, rebuild, workflow

RNG = np.random.default_rng(11)


def cloud(spark, xyz, g=None):
    rows = [(i, *map(float, p), int(g[i]) if g is not None else 0) for i, p in enumerate(xyz)]
    return spark.createDataFrame(rows, "point_id long, x double, y double, z double, g long")


@pytest.mark.parametrize("k", [1, 6, 500])
def test_nearest_distances_are_brute_force(spark, k):
    p = np.vstack([RNG.normal(scale=0.01, size=(120, 3)), RNG.uniform(-5, 5, (60, 3)), [[40, 0, 0]], np.zeros((5, 3))])
    got = {r.point_id: r.distances for r in points.nearest_distances(cloud(spark, p), k).collect()}
    d = np.sort(np.linalg.norm(p[:, None] - p[None], axis=2), axis=1)[:, 1 : k + 1]
    assert len(got) == len(p)
    for i, row in enumerate(d):
        assert np.allclose(got[i], row)


def test_odd_clouds_have_neighbours(spark):
    assert points.nearest_distances(cloud(spark, []), 3).count() == 0
    assert [r.distances for r in points.nearest_distances(cloud(spark, [(1, 2, 3)]), 3).collect()] == [[]]
    assert [r.distances for r in points.nearest_distances(cloud(spark, [(1, 2, 3)] * 3), 2).collect()] == [[0.0, 0.0]] * 3
    assert points.outliers(cloud(spark, [])).count() == 0


def test_outliers_are_brute_force(spark):
    p = np.vstack([RNG.uniform(0, 1, (300, 3)), [[4, 4, 4], [-3, 0, 0]]])
    got = {r.point_id for r in points.outliers(cloud(spark, p)).collect() if r.outlier}
    d = np.sort(np.linalg.norm(p[:, None] - p[None], axis=2), axis=1)[:, 1:7].mean(1)
    assert got == set(np.flatnonzero(d > d.mean() + 2 * d.std()).tolist()) >= {300, 301}


@pytest.mark.parametrize("local", [0, 10**6])
def test_a_long_chain_is_suppressed_every_second(spark, local):
    n = 24 if local == 0 else 300
    rows = [(k, "box", float(k), 0.0, 0.0, float(k) + 2, 1.0, 1.0, 100, 0.9 - k / 1000) for k in range(n)]
    df = spark.createDataFrame(rows, "k long, shape string, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double, point_count long, confidence double")
    assert sorted(r.k for r in clusters.suppressed(df, 0.3, 0.9, local).collect()) == list(range(0, n, 2))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=80))
def test_losers_are_those_of_the_greedy_pass(pairs):
    edges = sorted({(max(p), min(p)) for p in pairs if p[0] != p[1]})  # the smaller number is the better row
    kept, lost = [], []
    for k in range(31):
        (lost if any((k, b) in set(edges) for b in kept) else kept).append(k)
    assert clusters.losers(edges) == lost


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9)), min_size=1, max_size=40))
def test_hulls_hold_all_points(p):
    h = fits.hull(np.array(p, float))
    assert {tuple(x) for x in h.astype(int).tolist()} <= set(p)
    if len(h) > 2:
        for a, b in zip(h, np.roll(h, -1, axis=0), strict=True):
            side = [(b[0] - a[0]) * (q[1] - a[1]) - (b[1] - a[1]) * (q[0] - a[0]) for q in p]
            assert min(side) >= 0
        area = fits.smallest_rectangle(h)[3]
        turned = lambda t: np.ptp(h[:, 0] * math.cos(t) + h[:, 1] * math.sin(t)) * np.ptp(h[:, 1] * math.cos(t) - h[:, 0] * math.sin(t))
        assert area <= min(turned(t) for t in np.linspace(0, math.pi / 2, 60)) + 1e-6


def test_simplified_lines_stay_near():
    t = np.linspace(0, 6, 200)
    line = np.stack([t, np.sin(t)], 1)
    got = fits.simplified(line, 0.05)
    assert 5 < len(got) < 30 and got[0].tolist() == line[0].tolist() and got[-1].tolist() == line[-1].tolist()
    assert np.abs(np.interp(t, got[:, 0], got[:, 1]) - line[:, 1]).max() < 0.06
    assert fits.simplified(line, 10).tolist() == [line[0].tolist(), line[-1].tolist()]


def test_polygons_measure_squares(spark):
    p = [(x, y, 0) for x in np.linspace(0, 4, 20) for y in np.linspace(0, 2, 20)]
    r = fits.polygons(cloud(spark, p), "g").first()
    assert (r.n, r.corners, round(r.area, 6)) == (400, 4, 8.0)


def turned(p, degrees, about=2):
    a = math.radians(degrees)
    m = np.eye(3)
    i, j = [k for k in range(3) if k != about]
    m[i, i], m[i, j], m[j, i], m[j, j] = math.cos(a), -math.sin(a), math.sin(a), math.cos(a)
    return np.asarray(p) @ m.T


def test_a_pipe_is_found_again(spark):
    t, u = RNG.uniform(0, 2 * math.pi, 400), RNG.uniform(0, 3, 400)
    p = turned(np.stack([u, 0.08 * np.cos(t), 0.08 * np.sin(t)], 1), 40) + [5, 6, 1]
    r = rebuild.pipes(rebuild.measured(cloud(spark, p), "g"), "g").first()
    assert abs(r.diameter_m - 0.16) < 0.005 and abs(r.length_m - np.ptp(u)) < 0.02 and r.slope < 0.01 and r.confidence > 0.9 and r.start_x < r.end_x
    assert rebuild.pipes(rebuild.measured(cloud(spark, p[:14]), "g"), "g").count() == 0
    assert rebuild.pipes(rebuild.measured(cloud(spark, []), "g"), "g").count() == 0


def test_boxed_elements_are_plain_extents(spark):
    p = turned(RNG.uniform(-0.5, 0.5, (500, 3)) * [4, 0.6, 0.3], 25) + [1, 2, 3]
    m = rebuild.measured(cloud(spark, p), "g")
    c = p - p.mean(0)
    w, v = np.linalg.eigh(c.T @ c / len(c))
    spans = [float(np.ptp(c @ v[:, i])) for i in (2, 1, 0)]
    duct, tray, valve, box = rebuild.ducts(m, "g").first(), rebuild.cable_trays(m, "g").first(), rebuild.valves(m, "g").first(), rebuild.oriented_boxes(m, "g").first()
    assert np.allclose([duct.length_m, duct.width_m, duct.height_m], spans, atol=1e-4) and duct.confidence == 0.85
    assert np.allclose([tray.length_m, tray.width_m, tray.depth_m], spans, atol=1e-4)
    assert np.allclose([valve.length_m, valve.width_m, valve.height_m], sorted(spans, reverse=True), atol=1e-4) and valve.confidence == 0.65
    assert np.allclose([2 * box.half_u, 2 * box.half_v, 2 * box.half_w], spans, atol=2e-4)
    features = rebuild.patch_features(m, "g").first()
    assert math.isclose(features.linearity, (w[2] - w[1]) / w[2], abs_tol=1e-3) and math.isclose(features.curvature, w[0] / w.sum(), abs_tol=1e-3)


@pytest.mark.parametrize("degrees", [0, 30, 45, 90, 160])
def test_a_wall_of_two_faces_is_found_again(spark, degrees):
    n = 1500
    face = RNG.integers(0, 2, n) * 0.2 + RNG.normal(scale=0.003, size=n)
    p = turned(np.stack([RNG.uniform(0, 5, n), face, RNG.uniform(0, 3, n)], 1), degrees) + [3, 1, 0]
    r = rebuild.validated_walls(rebuild.walls(cloud(spark, p), "g")).first()
    assert abs(r.thickness_m - 0.2) < 0.02 and r.method == "faces" and abs(r.length_m - 5) < 0.05 and abs(r.height_m - 3) < 0.02 and r.status == "ACCEPTED"
    assert min(abs(r.degrees - degrees % 180), 180 - abs(r.degrees - degrees % 180)) < 0.5
    assert math.isclose(math.hypot(r.end_x - r.start_x, r.end_y - r.start_y), r.length_m, abs_tol=1e-3)


def test_round_and_square_columns(spark):
    t, z = RNG.uniform(0, 2 * math.pi, 600), RNG.uniform(0, 3, 600)
    ring = np.stack([0.2 * np.cos(t) + 4, 0.2 * np.sin(t) + 2, z], 1)
    square = turned(np.stack([np.where(t < 3, 0.3, RNG.uniform(-0.3, 0.3, 600)), RNG.uniform(-0.15, 0.15, 600), z], 1), 20)
    got = {r.g: r for r in rebuild.columns(cloud(spark, np.vstack([ring, square]), [0] * 600 + [1] * 600), "g").collect()}
    assert got[0].profile == "CIRCULAR" and abs(got[0].width_m - 0.4) < 0.01 and abs(got[0].centre_x - 4) < 0.01
    assert got[1].profile == "RECTANGULAR" and sorted([round(got[1].width_m, 1), round(got[1].depth_m, 1)]) == [0.3, 0.6]


def test_a_slab_has_its_area(spark):
    p = np.stack([RNG.uniform(0, 6, 2000), RNG.uniform(0, 4, 2000), RNG.normal(scale=0.004, size=2000) + 3], 1)
    r = rebuild.validated_slabs(rebuild.slabs(cloud(spark, p), "g")).first()
    assert abs(r.area_m2 - 24) < 0.6 and r.thickness_m == 0.1 and r.status == "ACCEPTED" and r.nz > 0.99


def test_poses(spark):
    pose = filters.Transform([[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]], [1, 2, 3], 2.0)
    p = RNG.uniform(-5, 5, (20, 3))
    back = pose.apply(pose.apply(cloud(spark, p)), back=True).orderBy("point_id").collect()
    assert np.allclose([(r.x, r.y, r.z) for r in back], p)
    assert pose.faults() == [] and len(pose.fingerprint("s")) == 64 and pose.fingerprint("s") != pose.fingerprint("t")
    assert pose.stamped(spark.range(2), "s").first().pose_valid


def test_ncr_steps_follow_the_fold(spark):
    rows, want = [], {}
    for i in range(60):
        state = "NONE"
        for j, action in enumerate(RNG.choice(["RAISED", "RESOLVED", "CLOSED"], RNG.integers(1, 9)).tolist()):
            legal = state in workflow.STEPS[action]
            after = {"RAISED": "OPEN"}.get(action, action) if legal else state
            rows.append((i, j, action))
            want[i, j] = (state, after, legal)
            state = after
    df = spark.createDataFrame(rows, "ncr_id long, step_id long, action string").selectExpr("*", "timestamp_seconds(step_id) AS ts").repartition(7)
    assert {(r.ncr_id, r.step_id): (r.before, r.after, r.legal) for r in workflow.ncr_steps(df).collect()} == want


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, name):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(type("Session", (), {"sparkContext": Context()})())
