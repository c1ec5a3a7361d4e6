"""Chains, gates and streams."""

import datetime
import hashlib
import hmac
import json
import os

from pyspark.sql import functions as F

from plumbline.operators import ledger
from plumbline.plans.views import view
from plumbline.streaming import ledger as stream

SF, KEY = "/root/testdata/sf0.001", b"a key"


def plain_chain(rows):
    out, last = {}, {}
    for r in sorted(rows, key=lambda r: (r.session_id, r.ts, r.event_id)):
        before = last.get(r.session_id)
        text = "|".join([str(r.event_id), str(r.session_id), r.event_type, r.ts.replace(tzinfo=datetime.UTC).isoformat(), before or ""])
        last[r.session_id] = hmac.new(KEY, text.encode(), hashlib.sha256).hexdigest()
        out[r.event_id] = (before, last[r.session_id])
    return out


def test_chain_is_the_plain_one_and_faults_show(spark):
    events = view(spark, SF, "audit_v")
    chain = ledger.chained(events, KEY).cache()
    want = plain_chain(events.collect())
    assert {r.event_id: (r.previous_hash, r.event_hash) for r in chain.collect()} == want
    assert ledger.verified(chain, KEY).count() == 0
    third = {r.event_hash: r for r in chain.collect()}
    victim = min((r for r in third.values() if r.previous_hash and third[r.previous_hash].previous_hash), key=lambda r: r.event_id)
    bad = chain.withColumn("event_type", F.when(F.col("event_id") == victim.event_id, "forged").otherwise(F.col("event_type")))
    assert [(r.event_id, r.reason) for r in ledger.verified(bad, KEY).collect()] == [(victim.event_id, "hash_mismatch")]
    gone = chain.filter(F.col("event_hash") != victim.previous_hash)
    assert [(r.event_id, r.reason) for r in ledger.verified(gone, KEY).collect()] == [(victim.event_id, "chain_break")]


def test_native_hmac(spark):
    for key in (b"k", b"x" * 100):
        got = spark.range(1).select(ledger.hmac_sha256(key, F.lit("é text")).alias("h")).first().h
        assert got == hmac.new(key, "é text".encode(), hashlib.sha256).hexdigest()


def test_signatures(spark):
    rows = [(1, 1, "PREPARER", "a", None, "h1"), (1, 2, "VERIFIER", "b", "h1", "h2"), (2, 1, "VERIFIER", "a", None, "h1"), (3, 1, "PREPARER", "a", None, "h1"), (3, 2, "VERIFIER", "a", "h1", "h2"), (4, 1, "PREPARER", "a", None, "h1"), (4, 2, "VERIFIER", "b", "hx", "h2")]
    got = ledger.signatures_valid(spark.createDataFrame(rows, "session_id long, seq long, role string, signer string, previous_hash string, hash string"))
    assert {r.session_id: r.valid for r in got.collect()} == {1: True, 2: False, 3: False, 4: False}


def test_release_states(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, True), (2, 0, 1, 0, True), (3, 1, 0, 0, True), (4, 0, 0, 0, False)], "session_id long, pending long, open_ncr long, pending_gates long, chain_ok boolean")
    assert {r.session_id: r.may_be for r in ledger.release(df).collect()} == {1: "PUBLISHED", 2: "SHARED", 3: "WIP", 4: "SHARED"}


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i // 20}:{i % 20 * 3:02d}:00", i % 3, "click" if i % 2 else "view", float(i)) for i in range(60)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, session_id long"
    for part in range(3):
        lines = [{"event_id": i, "ts": t, "user_id": u, "event_type": e, "value": v, "session_id": u} for i, t, u, e, v in rows[part * 20 : part * 20 + 20]]
        (tmp_path / f"{part}.json").write_text("\n".join(json.dumps(x) for x in lines + lines[:5]))
        os.utime(tmp_path / f"{part}.json", (1_700_000_000 + 60 * part,) * 2)  # the stream takes files by their time
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        assert run(stream.once(read()), "once").count() == 60
        assert run(stream.rates(stream.once(read()), "1 hour", None), "rates").agg(F.sum("n")).first()[0] in (40, 60)
        assert run(stream.sessions(read()), "sessions").count() >= 0
        for i, f in enumerate(sorted(tmp_path.glob("*.json"))):
            f.write_text("\n".join(f.read_text().splitlines()[:20]))
            os.utime(f, (1_700_000_000 + 60 * i,) * 2)
        chain = run(stream.chained(read(), KEY), "chain").cache()
        assert chain.count() == 60 and ledger.verified(chain, KEY).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
