"""Tables with many copies, and joins that Spark would have the driver broadcast."""

import itertools
import math

import pytest

from plumbline.operators import clusters, fits, openings, spatial, walls

BOX = ["segment_id", "zone_id", "shape", "element_type", "point_count", "confidence", "k", *(f"{m}_{a}" for m in ("min", "max") for a in "xyz"), "cx", "cy", "cz"]


def boxes(spark, n=120, places=9, shape="plane_vertical", kinds=("wall", "floor", "pipe"), size=(600.0, 90.0, 500.0), step=(350.0, 90.0, 40.0)):
    rows = []
    for k in range(n):
        p = k * 7 % places
        low = [p % 3 * step[0], p // 3 * step[1], p * step[2]]
        high = [a + s for a, s in zip(low, size, strict=True)]
        rows.append((f"s{k:04}", f"Z{k % 5}", shape, kinds[p % len(kinds)], 10 + k, 0.5, k, *low, *high, *((a + b) / 2 for a, b in zip(low, high, strict=True))))
    return spark.createDataFrame(rows, BOX), rows


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def centre(r):
    return r[-3:]


def near(rows, radius):
    return {(a[6], b[6]): math.dist(centre(a), centre(b)) for a, b in itertools.combinations(rows, 2) if math.dist(centre(a), centre(b)) <= radius}


def test_service_pairs_of_copies(spark):
    df, rows = boxes(spark, shape="cylinder")
    got = spatial.mep_edges(df, 400.0)
    assert not broadcasts(got)
    assert {(r.a, r.b): r.distance_mm for r in got.collect()} == {p: pytest.approx(d, abs=1e-3) for p, d in near(rows, 400.0).items()}


def grown(pairs, nodes):
    """Smallest node of each node's component."""
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_networks_of_copies(spark):
    df, rows = boxes(spark, n=60, shape="cylinder")
    rows = [r for r in rows if r[6] not in (0, 9, 18, 27, 36, 45)] + [(*rows[0][:6], 999, *rows[0][7:-3], 9e5, 0.0, 0.0)]
    got = {r.k: r.network for r in spatial.mep_networks(spark.createDataFrame(rows, BOX), 300.0).collect()}
    pairs = near(rows, 300.0)
    assert got == grown(pairs, {x for p in pairs for x in p}) and 999 not in got


@pytest.mark.parametrize("moved", [0.0, 100.0])
def test_deviation_of_copies(spark, moved):
    df, rows = boxes(spark, n=90)
    far = [(*r[:-3], r[-3] + 9e5, *r[-2:]) for r in rows[:4]]
    design = [(f"g{i}", r[-3] + moved, r[-2], r[-1]) for i, r in enumerate(rows[:30] + far[:2])]
    scan = rows + far[2:]
    got = spatial.deviation(spark.createDataFrame(design, "global_id string, dx double, dy double, dz double"), spark.createDataFrame(scan, BOX))
    assert not broadcasts(got)
    want = set()
    for g, *c in design:
        d, s = min((math.dist(c, centre(r)), r[0]) for r in scan)
        want.add((g, s, "MATCHED" if d < 25 else "SHIFTED", round(d, 3)) if d < 150 else (g, None, "MISSING", None))
    want |= {(None, r[0], "EXTRA", None) for r in scan if all(math.dist(c, centre(r)) >= 150 for _, *c in design)}
    assert {tuple(r) for r in got.collect()} == want


def test_heatmap_counts_places(spark):
    from plumbline.operators import quality
    from plumbline.plans import catalog

    _, rows = boxes(spark, n=90)
    far = [(*r[:-3], r[-3] + 9e5, *r[-2:]) for r in rows[:4]] + [(*rows[0][:-3], x, 0.0, 0.0) for x in (None, math.nan, math.inf, -0.0)]
    design = spark.createDataFrame([(f"g{i}", r[-3] + 4 * i if r[-3] is not None else None, r[-2], r[-1]) for i, r in enumerate(rows[:30] + far[:2] + far[4:])], "global_id string, dx double, dy double, dz double")
    scan = spark.createDataFrame([(f"t{i}", *r[-3:]) for i, r in enumerate(rows + far[2:])], "segment_id string, cx double, cy double, cz double")
    got = quality.heatmap(spatial.deviation_counts(design, scan), "n")
    assert not broadcasts(got)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in quality.heatmap(spatial.deviation(design, scan)).collect()}
    # No element is joined by its own: copies of a place make no rows of theirs.
    plan = catalog.QUERIES["deviation_heatmap"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "global_id" not in plan and "segment_id" not in plan


def cloud(spark, n=160):
    """Points on few places, in an order that mixes them, with one far off, one beside its cluster and one nowhere."""
    at = [(i % 4 * 0.3, i // 4 * 0.3, 0.0) for i in range(8)] + [(5 + i % 2 * 0.3, i // 2 * 0.3, 1.0) for i in range(4)]
    rows = [(k, *at[k * 5 % len(at)]) for k in range(n)] + [(n, 50.0, 0.0, 0.0), (n + 1, 1.25, 0.0, 0.0), (n + 2, None, 0.0, 0.0)]
    return spark.createDataFrame(rows, "point_id long, x double, y double, z double"), rows


@pytest.mark.parametrize("least", [1, 10, 30, 60])
def test_dbscan_of_copies(spark, least):
    df, rows = cloud(spark)
    rows = [r for r in rows if r[1] is not None]
    near_ = {a[0]: [b[0] for b in rows if math.dist(a[1:], b[1:]) <= 0.36] for a in rows}
    cores = [k for k, v in near_.items() if len(v) >= least]
    root = grown([(a, b) for a in cores for b in near_[a] if b in cores and a < b], cores)
    want = root | {k: min(root[c] for c in v if c in root) for k, v in near_.items() if k not in root and any(c in root for c in v)}
    assert {r.point_id: r.cluster for r in clusters.dbscan(df, 0.36, least).collect()} == want | ({162: 162} if least == 1 else {})


def test_dbscan_pairs_places_only(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(clusters, "stored", lambda df, name, keep=clusters.stored: seen.append((name, keep(df, name))) or seen[-1][1])
    clusters.dbscan(cloud(spark)[0], 0.36, 10).collect()
    assert dict(seen)["pairs"].count() < 100  # of 163 points some 5000


@pytest.mark.parametrize("least", [1, 20])
def test_euclidean_of_copies(spark, least):
    df, rows = cloud(spark)
    got = clusters.euclidean(df, 0.36, least)
    assert not broadcasts(got)
    placed = [r for r in rows if r[1] is not None]
    root = grown([(a[0], b[0]) for a, b in itertools.combinations(placed, 2) if math.dist(a[1:], b[1:]) <= 0.36], [r[0] for r in rows])
    want = {k: r for k, r in root.items() if list(root.values()).count(r) >= least}
    assert {r.point_id: r.cluster for r in got.collect()} == want


def test_normals_of_copies(spark):
    df, rows = cloud(spark)
    got = fits.normals(df, 0.5)
    assert not broadcasts(got)
    own = {r.point_id: r for r in got.collect()}
    plain = {k: [p[1:] for p in rows if p[1] is not None and math.dist(p[1:], at) <= 0.5] for k, *at in rows if at[0] is not None}
    assert {k: r.n for k, r in own.items()} == {k: len(v) for k, v in plain.items()}
    pairs = spark.createDataFrame([(k, *map(float, p)) for k, v in plain.items() for p in v], "point_id long, x double, y double, z double")
    for r in fits.eigen(pairs, "point_id").collect():
        assert own[r.point_id].planarity == pytest.approx(r.planarity, abs=1e-9)
        if r.l2 > 1e-6:
            assert abs(r.nx * own[r.point_id].nx + r.ny * own[r.point_id].ny + r.nz * own[r.point_id].nz) == pytest.approx(1, abs=1e-9)


def plain_merge(rows):
    """Roots of flat segments by the rule as stated, pair by pair."""
    links = []
    for a, b in itertools.combinations([r for r in rows if r[2].startswith("plane")], 2):
        (al, ah), (bl, bh) = (((r[7], r[9], r[11]), (r[8], r[10], r[12])) for r in (a, b))
        gap = [max(x, y) - min(u, v) for x, y, u, v in zip(al, bl, ah, bh, strict=True)]
        if a[2] != b[2] or abs(a[15] - b[15]) >= (300 if a[2] == "plane_sloped" else 150) or max(gap) > 0:
            continue
        both = math.prod(max(-g, 0) for g in gap)
        va, vb = (math.prod(h - l for l, h in zip(*x, strict=True)) for x in ((al, ah), (bl, bh)))
        share, inner = (both / (va + vb - both) if va + vb - both else 0), (both / min(va, vb) if min(va, vb) else 0)
        side = (-gap[0] > 300 and gap[1] <= 120) or (-gap[1] > 300 and gap[0] <= 120)
        if share >= 0.65 or inner >= 0.9 or (side and (-gap[2] > 300 or a[2] != "plane_vertical")):
            links.append((a[6], b[6]))
    return grown(links, [r[6] for r in rows])


@pytest.mark.parametrize("shape, size", [("plane_vertical", (600.0, 90.0, 500.0)), ("plane_sloped", (600.0, 200.0, 250.0)), ("plane_horizontal", (300.0, 0.0, 0.0)), ("plane_vertical", (100.0, 0.0, 200.0)), ("box", (600.0, 90.0, 500.0))])
def test_merge_of_copies(spark, shape, size, monkeypatch):
    linked = []
    monkeypatch.setattr(clusters, "components", lambda links, keep=clusters.components: linked.append(links) or keep(links))
    order = [*BOX[:7], "min_x", "max_x", "min_y", "max_y", "min_z", "max_z", *BOX[-3:]]
    df, _ = boxes(spark, n=60, shape=shape, size=size)
    rows = [tuple(r) for r in df.select(*order).collect()]
    got = {r.merged: (r.parts, r.point_count) for r in clusters.merged(df).collect()}
    want = {}
    for k, root in plain_merge(rows).items():
        parts, points = want.get(root, (0, 0))
        want[root] = (parts + 1, points + 10 + k)
    assert got == want
    if min(size) > 0:
        assert linked[0].count() <= 36  # nine boxes, however many copies


def test_rounding_of_doubles_beside_a_half(spark):
    from plumbline.functions import exprs as E
    from pyspark.sql import functions as F
    import duckdb

    values = [0.5438365000000001, 0.16501949999999999, 0.5241815, 0.33860250000000003, -0.5438365000000001, 0.25, 0.1234564]
    want = [duckdb.sql(f"SELECT round_even({v!r}::DOUBLE, 6)").fetchall()[0][0] for v in values]
    assert [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(E.round_even(F.col("v"), 6)).collect()] == want


def test_pairs_of_faces_in_one_pass(spark, monkeypatch):
    df, _ = boxes(spark, n=90)
    pairs = walls.face_candidates(df).select("a", "b", "distance_mm").collect()
    assert len({(r.a, r.b) for r in pairs}) == len(pairs) > 300 and all(r.a < r.b for r in pairs)
    want, used = {}, set()
    for a in range(90):
        best = min(((r.distance_mm, r.b) for r in pairs if r.a == a and r.b not in used), default=None)
        if a not in used and best:
            want[a] = best[1]
            used |= {a, best[1]}
    tables = []
    monkeypatch.setattr(openings, "stored", lambda d, name, keep=openings.stored: tables.append(name) or keep(d, name))
    own = spark.createDataFrame([(r.a, r.b, r.distance_mm) for r in pairs], "a long, b long, distance double")
    for most in (0, 10_000):
        assert {r.a: r.b for r in openings.paired(own, most).collect()} == want
    assert tables == ["candidates"] * 2  # no rounds


@pytest.mark.parametrize("at_once", [3, 256])
def test_clashes_counted_by_class(spark, monkeypatch, at_once):
    monkeypatch.setattr(spatial, "AT_ONCE", at_once)
    df, rows = boxes(spark, n=90)
    df = df.union(df.limit(9).selectExpr("concat('t', segment_id)", "null", *BOX[2:6], "k + 1000", *BOX[7:])).cache()
    want = {}
    for r in spatial.clashes(df).collect():
        want[r.zone_id, r.clash_type] = want.get((r.zone_id, r.clash_type), 0) + 1
    assert (None, "hard") in want
    monkeypatch.setattr(spatial, "clashes", None)
    assert {(r.zone_id, r.clash_type): r.n for r in spatial.clash_counts(df).collect()} == want


def test_relations_of_copies(spark):
    from plumbline.operators import semantics

    df, rows = boxes(spark, n=45)
    got = spatial.topology(df).collect()
    kind = {r[6]: r[3] for r in rows}
    box = {r.k: r for r in df.collect()}
    close = lambda a, b: all(max(box[a][f"min_{x}"], box[b][f"min_{x}"]) - min(box[a][f"max_{x}"], box[b][f"max_{x}"]) <= 250 for x in "xyz")
    want = {(a, b, "CONNECTED_TO") for a in kind for b in kind if a != b and kind[a] == kind[b] == "pipe" and close(a, b)}
    want |= {(a, b, "SUPPORTED_BY") for a in kind for b in kind if (kind[a], kind[b]) == ("wall", "floor") and close(a, b) and abs(box[a].min_z - box[b].max_z) < 250}
    want |= {(a, b, "INTERSECTS") for a in kind for b in kind if (kind[a], kind[b]) == ("wall", "floor") and close(a, b) and box[a].min_z <= box[b].max_z + 100}
    assert {(r.a, r.b, r.relation) for r in got} == want and len(got) == len(want)
    found, members = spatial.class_topology(df)
    assert found.count() < len(want) / 10
    whole = {r.a: (r.relations, r.boost) for r in semantics.reinforced(spatial.topology(df)).collect()}
    by_class = {r.a: (r.relations, r.boost) for r in semantics.reinforced(found).collect()}
    assert {m.member: by_class[m["class"]] for m in members.collect() if m["class"] in by_class} == whole
