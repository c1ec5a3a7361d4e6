"""Point files, JSON segments, CSV, STEP and JUnit."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import quality, segments
from plumbline.plans.views import view
from plumbline.sources import pointcloud, tables

SF = "/root/testdata/sf0.001"
XYZ = np.round(np.random.default_rng(1).uniform(-5, 5, (500, 3)), 3)


def las(path, xyz, rgb):
    head = bytearray(227)
    head[0:4] = b"LASF"
    head[24:26] = bytes([1, 2])
    struct.pack_into("<HII", head, 94, 227, 227, 0)
    head[104] = 2
    struct.pack_into("<HI", head, 105, 26, len(xyz))
    struct.pack_into("<3d3d", head, 131, 0.001, 0.001, 0.001, 10.0, 20.0, 30.0)
    body = b"".join(struct.pack("<3iH6x3H", *(round((v - o) / 0.001) for v, o in zip(p, (10, 20, 30), strict=True)), 7, *c) for p, c in zip(xyz, rgb, strict=True))
    path.write_bytes(bytes(head) + body)


def got(spark, path, **options):
    return np.array(sorted(tuple(r) for r in pointcloud.load(spark, str(path), **options).select("x", "y", "z").collect()))


WANT = np.array(sorted(map(tuple, XYZ)))


def test_text_in_ranges(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("# x y z\n" + "\n".join(" ".join(map(str, p)) for p in XYZ) + "\n\n")
    for size in (64, 1000, 1 << 20):
        assert np.allclose(got(spark, tmp_path / "a.xyz", rangebytes=size), WANT)
    assert pointcloud.load(spark, str(tmp_path / "a.xyz"), rangebytes=64).select("point_id").distinct().count() == 500


def test_ply_ascii_and_binary(spark, tmp_path):
    head = "ply\nformat {} 1.0\nelement vertex 500\nproperty float64 x\nproperty double y\nproperty double z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nelement face 0\nproperty list uchar int vertex_indices\nend_header\n"
    (tmp_path / "a.ply").write_text(head.format("ascii") + "\n".join(" ".join(map(str, p)) + " 255 0 51" for p in XYZ) + "\n")
    (tmp_path / "b.ply").write_bytes(head.format("binary_little_endian").encode() + b"".join(struct.pack("<3d3B", *p, 255, 0, 51) for p in XYZ))
    for name in "ab":
        assert np.allclose(got(spark, tmp_path / f"{name}.ply", rangebytes=300), WANT)
    c = pointcloud.unit_colours(pointcloud.load(spark, str(tmp_path / "b.ply"))).first()
    assert (c.r, c.g, round(c.b, 6)) == (1.0, 0.0, 0.2)


def test_pcd_and_las(spark, tmp_path):
    head = "# .PCD v0.7\nVERSION 0.7\nFIELDS x y z\nSIZE 8 8 8\nTYPE F F F\nCOUNT 1 1 1\nWIDTH 500\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS 500\nDATA {}\n"
    (tmp_path / "a.pcd").write_bytes(head.format("binary").encode() + XYZ.astype("<f8").tobytes())
    (tmp_path / "b.pcd").write_text(head.format("ascii") + "\n".join(" ".join(map(str, p)) for p in XYZ))
    las(tmp_path / "c.las", XYZ, [(65535, 0, 13107)] * 500)
    for name in ("a.pcd", "b.pcd", "c.las"):
        assert np.allclose(got(spark, tmp_path / name, rangebytes=500), WANT, atol=1e-6)
    c = pointcloud.unit_colours(pointcloud.load(spark, str(tmp_path / "c.las"))).first()
    assert (c.r, c.g, round(c.b, 6), c.intensity) == (1.0, 0.0, 0.2, 7.0)
    assert pointcloud.load(spark, str(tmp_path)).count() == 1500


def test_wrong_files(spark, tmp_path):
    (tmp_path / "a.ply").write_text("1 2 3\n")
    with pytest.raises(Exception, match="content"):
        pointcloud.load(spark, str(tmp_path / "a.ply")).count()
    (tmp_path / "b.bin").write_bytes(b"x")
    errors = {r.path.rsplit("/")[-1]: r.errors for r in pointcloud.validate(spark, str(tmp_path), 3).collect()}
    assert errors == {"a.ply": [], "b.bin": ["too_small", "unknown_format"]}


def test_segments_round_trip(spark, tmp_path):
    df = view(spark, SF, "segments_v")
    tables.write_segments(df, str(tmp_path / "s"))
    back = tables.read_segments(spark, str(tmp_path / "s"))
    assert back.exceptAll(df.select(*back.columns)).count() == 0 and back.count() == df.count()
    (tmp_path / "bad.json").write_text('{"segment_id": "a", "min_x": "no number"}\n')
    with pytest.raises(Exception):
        tables.read_segments(spark, str(tmp_path / "bad.json")).collect()


def test_exports(spark, tmp_path):
    c = segments.classified(view(spark, SF, "segments_v"))
    rows = quality.handover(c)
    tables.write_handover_csv(rows, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == rows.count()
    lines = tables.step_lines(c).orderBy("n").collect()
    assert [r.n for r in lines] == list(range(1, c.count() + 1)) and lines[0].line.startswith("#101=IFC")
    assert tables.svg_shapes(c).filter(F.col("shape").startswith("<rect")).count() == c.count()


def test_junit(spark, tmp_path):
    (tmp_path / "r.xml").write_text('<testsuite><testcase name="a"/><testcase name="b"><failure>no</failure></testcase><testcase name="c"><skipped>s</skipped></testcase></testsuite>')
    assert tuple(tables.junit_totals(spark, str(tmp_path / "r.xml")).first()) == (3, 1, 0, 1)
