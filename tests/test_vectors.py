"""Nearest vectors against all pairs, one by one."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators import vectors


def plain(df, every, k):
    pairs = vectors._each(df.filter(F.pmod("vec_id", F.lit(every)) == 0), df).select("query_id", "vec_id", F.bround("d", 4).alias("d2"))
    order = W.partitionBy("query_id").orderBy(F.asc_nulls_last("d2"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order).cast("long") - 1).filter(F.col("rank") < k).select("query_id", "rank", "vec_id", "d2")


@pytest.mark.parametrize("kind,scale,odd", [("float", 1.0, False), ("double", 1.0, True), ("float", 0.004, True), ("float", 1e7, False)])
def test_nearest_are_those_of_all_pairs(spark, monkeypatch, kind, scale, odd):
    for name, value in (("TILE_QUERIES", 16), ("TILE_VECTORS", 100), ("BLOCK_QUERIES", 7), ("BLOCK_VECTORS", 30)):
        monkeypatch.setattr(vectors, name, value)
    rng = random.Random(7)
    rows = [(i, [scale * rng.gauss(0, 1) for _ in range(5)]) for i in range(-40, 260)]
    rows += [(i, list(rows[i % 4][1])) for i in range(300, 420)]  # large groups of copies
    rows += [rows[3], rows[3], (rows[8][0], [scale] * 5), (50, [0.0] * 5), (51, [-0.0] * 5)]  # repeated ids
    rows += [(i, [scale * rng.randrange(3) for _ in range(5)]) for i in range(500, 600)]  # ties
    if odd:
        rows += [(600, None), (601, [None] * 5), (602, [1.0]), (605, [1e30] * 5), (610, [float("inf")] * 5), (None, [0.0] * 5), (615, [])]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    got, want = (sorted(map(repr, f(df, 5, 3).collect())) for f in (vectors.nearest_vectors, plain))
    assert got == want


def test_few_rows(spark):
    for rows in ([], [(0, [1.0, 2.0])], [(0, [1.0, 2.0]), (1, [1.0, 2.5])], [(0, None), (5, None)], [(0, []), (5, [])]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        assert sorted(map(repr, vectors.nearest_vectors(df, 5, 3).collect())) == sorted(map(repr, plain(df, 5, 3).collect()))


def test_pairs_are_no_rows(spark):
    """Pairs are looked at in matrix products: no join makes a row of each."""
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(300)], "vec_id long, embedding array<float>")
    plan = vectors.nearest_vectors(df)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
