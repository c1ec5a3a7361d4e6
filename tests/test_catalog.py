"""Every query that SQL can express gives what DuckDB gives on the same tables; the others run."""

import duckdb
import pytest

from plumbline.plans import catalog, more  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else v


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_is_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    result = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert table([tuple(r) for r in df.collect()], df.columns) == table(result.fetchall(), names)


#: Rows on the smallest tables of the queries without SQL, at least and at most; tests of their operators check the values.
ROWS = {"bounding_rectangles": (6, 6), "outline_polygons": (6, 6), "pca_features": (6, 6), "oriented_boxes": (6, 6), "patch_features": (6, 6), "pipe_fits": (8, 8), "duct_fits": (8, 8), "cable_tray_fits": (8, 8), "valve_fits": (8, 8), "slab_fits": (2, 2), "wall_fits": (6, 6), "statistical_outliers": (1500, 1500), "point_normals": (1500, 1500), "step_export": (200, 10**4), "overlap_suppression": (1, 200), "wall_openings": (4, 4), "paired_faces": (0, 100)}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    low, high = ROWS.get(name, (1, 10**5))
    assert low <= catalog.QUERIES[name](spark, SF).count() <= high


def test_entry_point_works_alone(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
