"""Openings, pairs and wall ends against known walls and plain passes."""

import numpy as np
import pytest

from plumbline.operators import openings

RNG = np.random.default_rng(5)


def test_a_door_and_a_window_are_found(spark):
    p = np.stack([RNG.uniform(0, 8, 30_000), RNG.normal(scale=0.01, size=30_000), RNG.uniform(0, 3, 30_000)], 1)
    hole = lambda a, b, lo, hi: (p[:, 0] > a) & (p[:, 0] < b) & (p[:, 2] > lo) & (p[:, 2] < hi)
    p = p[~hole(1.5, 2.5, -1, 2.9) & ~hole(4.5, 6.0, 0.2, 2.8)]
    a = np.radians(30)
    turned = p @ np.array([[np.cos(a), np.sin(a), 0], [-np.sin(a), np.cos(a), 0], [0, 0, 1]])
    points = spark.createDataFrame([(7, *map(float, x)) for x in turned] + [(8, 0.0, 0.0, 0.0)], "wall long, x double, y double, z double")
    walls = spark.createDataFrame([(7, 0.0, 0.0, 8 * float(np.cos(a)), 8 * float(np.sin(a)), 0.0, 3.0, 0.2)], "wall long, start_x double, start_y double, end_x double, end_y double, base_m double, height_m double, thickness_m double")
    got = openings.wall_openings(points, walls, "wall").orderBy("opening").collect()
    assert [r.kind for r in got] == ["DOOR", "DOOR"] and [r.opening for r in got] == [0, 1]
    assert abs(got[0].u0 - 1.5) < 0.11 and abs(got[0].u1 - 2.5) < 0.11 and abs(got[1].u0 - 4.5) < 0.11 and abs(got[1].height_m - 2.6) < 0.21
    assert openings.wall_openings(points.limit(0), walls, "wall").count() == 0


@pytest.mark.parametrize("local", [0, 10**6])
def test_pairs_are_those_of_the_ordered_pass(spark, local):
    pairs = sorted({(int(a), int(b)) for a, b in RNG.integers(0, 40, (120, 2)) if a < b})
    rows = [(a, b, float(RNG.integers(0, 5))) for a, b in pairs]
    used, want = set(), []
    for a in range(40):
        best = min(((d, y) for x, y, d in rows if x == a and y not in used), default=None) if a not in used else None
        if best:
            used |= {a, best[1]}
            want.append((a, best[1], best[0]))
    got = openings.paired(spark.createDataFrame(rows, "a long, b long, distance double"), local)
    assert sorted(map(tuple, got.collect())) == want


def test_ends_meet_at_the_corner(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 4.8, 0.1), (2, 5.0, 0.3, 5.1, 4.0), (3, 0.0, 0.2, 4.0, 0.2), (4, 20.0, 0.0, 24.0, 0.0)], "wall long, start_x double, start_y double, end_x double, end_y double")
    got = {r.wall: r for r in openings.snapped(df, "wall").collect()}
    assert got[1].moved == 1 and got[2].moved == 1 and got[3].moved == 0 and got[4].moved == 0
    assert abs(got[1].end_x - got[2].start_x) < 1e-9 and abs(got[1].end_y - got[2].start_y) < 1e-9
