"""Bundles, HTML, DXF, STEP and prediction files."""

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import segments
from plumbline.plans import catalog
from plumbline.plans.views import view
from plumbline.sources import reports, tables

SF = "/root/testdata/sf0.001"


def test_bundle_notices_changes(spark, tmp_path):
    parts = {n: catalog.QUERIES[n](spark, SF) for n in ("loa_distribution", "station_classes")}
    manifest = reports.bundle(parts, str(tmp_path / "b"))
    assert {r.section for r in manifest.collect()} == set(parts)
    assert reports.changed(spark, str(tmp_path / "b")).count() == 0
    file = next((tmp_path / "b" / "station_classes").glob("part-*"))
    file.write_text(file.read_text() + "\n{}")
    (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    assert [r.section for r in reports.changed(spark, str(tmp_path / "b")).collect()] == ["station_classes"]


def test_html_is_escaped_and_in_order(spark):
    rows = reports.html_rows(spark.createDataFrame([("b", "<x>"), ("a", None)], "k string, v string"), ["k"]).orderBy("n").collect()
    assert [r.line for r in rows] == ["<tr><th>k</th><th>v</th></tr>", "<tr><td>a</td><td></td></tr>", "<tr><td>b</td><td>&lt;x&gt;</td></tr>"]


def test_step_reads_back(spark, tmp_path):
    c = segments.classified(view(spark, SF, "segments_v"))
    tables.step_lines(c).select("line").write.text(str(tmp_path / "s"))
    back = reports.read_step(spark, str(tmp_path / "s"))
    assert back.count() == c.count() and back.select("global_id").exceptAll(c.select("segment_id")).count() == 0


def test_shapes_and_predictions(spark, tmp_path):
    assert "LINE" in reports.dxf_lines(spark.createDataFrame([(0.0, 0.0, 1.0, 2.0)], "x0 double, y0 double, x1 double, y1 double")).first().entity
    dots = reports.heatmap_shapes(spark.createDataFrame([(1.0, 2.0, None), (1.0, 2.0, 60.0)], "cx double, cy double, distance_mm double"))
    assert dots.filter(F.col("shape").contains("#c62828")).count() == 1
    np.save(tmp_path / "p.npy", np.arange(70000) % 5)
    got = reports.read_predictions(spark, str(tmp_path / "p.npy"))
    assert got.count() == 70000 and got.filter("label = point_id % 5").count() == 70000
