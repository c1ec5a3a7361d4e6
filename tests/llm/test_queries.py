"""The registered queries of this subpackage, on the smallest tables."""

import duckdb
import pytest

import corpus_pipeline
from plumbline.llm import queries
from plumbline.llm.common import fold, table

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op2": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "n_links": "bigint"},
    "op3": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op4": {"doc_id": "bigint", "ids": "array<int>", "n_tokens": "bigint", "intact": "boolean"},
    "op5": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op6": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op7": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op8": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op9": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns_and_rows(spark, name):
    op = name.split("_")[0]
    df = queries.QUERIES[name](spark, SF)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[op]} == COLUMNS[op]
    assert df.count() == table(spark, SF, "pages" if op in ("op5", "op10") else "documents").count()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(result.fetchall())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    lang = queries.op7_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert lang.filter("lang = lang_pred").count() >= 0.97 * lang.count()
    toxic = queries.op9_toxicity(spark, sf).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out")
    assert toxic.filter("toxic = 0 AND predicted = 0").count() >= 0.95 * toxic.filter("toxic = 0").count()
    more = "/root/testdata/sf0.1"
    found = queries.op9_toxicity(spark, more).join(table(spark, more, "labels").select("doc_id", "toxic"), "doc_id").filter("held_out AND toxic = 1")
    assert found.filter("predicted = 1").count() >= 0.9 * found.count() > 0
    held = queries.op6_lm_scoring(spark, sf).filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert held["sum(score)"] > 0.985 * held["sum(base_score)"]


def test_folds_are_crc32(spark):
    import zlib

    got = {r.doc_id: r.f for r in table(spark, SF, "documents").select("doc_id", fold("doc_id", 10).alias("f")).collect()}
    assert got == {k: zlib.crc32(str(k).encode()) % 10 for k in got}


def test_pipeline_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run and len(corpus_pipeline.STAGES) == 5
