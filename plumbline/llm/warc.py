"""WARC: a deterministic sharded writer with deduplication, committed through temporary names and manifests."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import hot_join
from .common import scratch, stored

#: Bytes of payload that a shard (one task's share) aims at, and compressed bytes after which a file is closed.
SHARD_BYTES, ROLL_BYTES = 32 << 20, 8 << 20
#: Keys sampled, by hash, to place the bounds of shards.
BOUNDS_SAMPLE = 50_000
#: Records carry a fixed date, so that equal input gives equal files.
DATE = "2000-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _key(value: object) -> str:
    """A key as a header's value: whatever is not plain is percent-encoded, so that it comes back as it is."""
    return quote(str(value), safe=" -_.:/" if str(value) == str(value).strip() else "")


def _clean(value: object) -> str:
    return " ".join(str(value).split())


def record(key: object, url: str | None, payload: bytes, name: str, refers_to: object = None) -> bytes:
    """One record as a gzip member. A revisit (refers_to is not None) has headers only, as its payload is stored elsewhere."""
    target = _clean(url) if url and url.strip() else f"urn:record:{quote(str(key))}"
    own = lambda k: f"<urn:uuid:{uuid.uuid5(_SPACE, f'{k}/{name}')}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {own(key)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"WARC-Payload-Digest: sha1:{name}",
        f"X-Payload-Length: {len(payload)}",
        *([f"X-Record-Key: {_key(key)}"] if key is not None else []),
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {own(refers_to)}", f"X-Refers-To-Key: {_key(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed stream. A record that breaks off raises."""
    while first := stream.readline():
        if first.strip() == b"":
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record here: {first[:40]!r}")
        head = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode().partition(":")
            head[k.strip()] = v.strip()
        block = stream.read(n := int(head["Content-Length"]))
        if len(block) < n:
            raise ValueError("a record breaks off")
        yield head, block


def _bounds(pages: DataFrame, key: str, text: str, shard_bytes: int) -> list:
    """Keys at which shards begin, from a sample of keys by hash: the same for the same rows, however they are partitioned."""
    n, total = pages.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    shards = max(1, -(-total // shard_bytes))
    if shards == 1:
        return []
    every = max(1, n // BOUNDS_SAMPLE)
    rows = sorted(tuple(r) for r in pages.filter(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(every)) == 0)).select(key, F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).collect())
    share, seen, out = sum(x[1] for x in rows) / shards, 0, []
    for k, size in rows:
        if seen >= share * (len(out) + 1) and (not out or out[-1] < k):
            out.append(k)
        seen += size
    return out


def write(pages: DataFrame, out: str, key: str = "page_id", url: str = "url", text: str = "html", least: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes one record for each row to `out` and returns the manifest: file, records, bytes, sha256.

    Of rows with equal payloads of at least `least` bytes, those with the largest key are responses, the others revisits of
    that key; a repeated row of the largest key is a response again. Null text is an empty payload, null keys sort first and
    never are the largest unless all are null, then all are responses. An empty table makes no file. Rows are sorted by key and digest
    within shards; the bounds of shards and so all files depend on the rows alone. A task writes under names of its own attempt; only
    files in the manifest, which Spark commits once a task, are then renamed, and a lost task leaves nothing that is read.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("p"))
    named = rows.select("k", F.sha1("p").alias("d"), F.length("p").alias("n"))
    groups = named.filter(F.col("n") >= least).groupBy("d").agg(F.max("k").alias("top"), F.count("*").alias("c")).filter("c > 1")
    again = hot_join(named.filter(F.col("n") >= least), groups, "d", "c", pages.count(), "inner").filter(F.col("top").isNotNull() & ~F.col("k").eqNullSafe(F.col("top"))).select("k", "d", "top").distinct()
    bounds = _bounds(pages, key, text, shard_bytes)
    shards = len(bounds) + 1

    # A revisit's note goes before its pages to the same shard, so that payloads are shuffled once.
    both = rows.select("k", "u", "p", F.sha1("p").alias("d"), F.lit(None).cast(rows.schema["k"].dataType).alias("top")).unionByName(again.select("k", F.lit(None).cast("string").alias("u"), F.lit(None).cast("binary").alias("p"), "d", "top"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = [0 if k is None else bisect_right(bounds, k) for k in b.column("k").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard, pa.int32())], names=[*b.schema.names, "shard"])

    schema = T.StructType([*both.schema.fields, T.StructField("shard", T.IntegerType())])
    dealt = both.mapInArrow(placed, schema).repartitionById(shards, "shard").sortWithinPartitions("shard", "k", "d", F.col("p").isNotNull(), "u")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(out)
        store.create_dir(f"{root}/tmp", recursive=True)
        attempt = uuid.uuid4().hex
        names = ["shard", "part", "tmp", "records", "bytes", "sha256"]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        shard, part, f, note, done = None, 0, None, None, []
        held = n = 0
        sha = None

        def close() -> None:
            nonlocal f
            if f:
                f.close()
                done.append((shard, part, f"{attempt}-{shard}-{part}", n, held, sha.hexdigest()))
                f = None

        for b in batches:
            for k, u, p, d, top, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p is None:
                    note = (k, d, top)
                    continue
                if f is None or s != shard or held >= roll_bytes:
                    close()
                    shard, part = s, part + 1 if s == shard else 0
                    f, held, n, sha = store.open_output_stream(f"{root}/tmp/{attempt}-{shard}-{part}", compression=None), 0, 0, hashlib.sha256()
                data = record(k, u, p, base64.b32encode(bytes.fromhex(d)).decode(), note[2] if note and note[:2] == (k, d) else None)
                f.write(data)
                sha.update(data)
                held, n = held + len(data), n + 1
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

    files = stored(dealt.mapInArrow(written, "shard int, part int, tmp string, records long, bytes long, sha256 string"), "written")

    def committed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(out)
        for b in batches:
            file = []
            for s, q, tmp in zip(*(b.column(c).to_pylist() for c in ("shard", "part", "tmp")), strict=True):
                file.append(f"records-{s:06d}-{q:05d}.warc.gz")
                if store.get_file_info(f"{root}/tmp/{tmp}").type != fs.FileType.NotFound:  # else an earlier attempt has moved it
                    store.move(f"{root}/tmp/{tmp}", f"{root}/{file[-1]}")
            yield pa.RecordBatch.from_arrays([pa.array(file, pa.string()), *[b.column(c) for c in ("records", "bytes", "sha256")]], names=["file", "records", "bytes", "sha256"])

    files.mapInArrow(committed, "file string, records long, bytes long, sha256 string").write.mode("overwrite").parquet(f"{out}/manifest")
    store, root = fs.FileSystem.from_uri(out)
    store.delete_dir(f"{root}/tmp") if store.get_file_info(f"{root}/tmp").type == fs.FileType.Directory else None
    return spark.read.schema("file string, records long, bytes long, sha256 string").parquet(f"{out}/manifest")


def read(spark: SparkSession, out: str, key: str = "page_id", key_type: str = "long") -> DataFrame:
    """One row for each record of the files in the manifest: key, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to.

    The payload's digest is computed again; a record that doesn't match raises. Files are dealt over tasks, one at a time in memory streams.
    """
    manifest = spark.read.schema("file string, records long, bytes long, sha256 string").parquet(f"{out}/manifest")
    names = ["k", "url", "payload", "payload_bytes", "payload_digest", "record_type", "to"]
    kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(out)
        own = lambda head, name: unquote(head[name]) if name in head else None
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for b in batches:
            for file, expected in zip(b.column("file").to_pylist(), b.column("records").to_pylist(), strict=True):
                rows, held, n = [], 0, 0
                with store.open_input_stream(f"{root}/{file}", compression=None) as raw, gzip.open(raw) as stream:
                    for head, block in records(stream):
                        payload = block.partition(b"\r\n\r\n")[2] if head["WARC-Type"] == "response" else None
                        name, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                        if payload is not None and (digest(payload) != name or len(payload) != size):
                            raise ValueError(f"{file}: a payload has changed")
                        rows.append((own(head, "X-Record-Key"), head["WARC-Target-URI"], payload, size, name, head["WARC-Type"], own(head, "X-Refers-To-Key")))
                        held, n = held + len(block), n + 1
                        if held > 4 << 20:
                            yield pack(rows)
                            rows, held = [], 0
                if rows:
                    yield pack(rows)
                if n != expected:
                    raise ValueError(f"{file}: {n} records of {expected}")

    files = manifest.select("file", "records").repartition(max(1, min(10_000, manifest.count())), "file")
    return files.mapInArrow(parsed, "k string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, to string").select(F.col("k").cast(key_type).alias(key), "url", "payload", "payload_bytes", "payload_digest", "record_type", F.col("to").cast(key_type).alias("refers_to"))


def archived(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "html", least: int = 0) -> DataFrame:
    """Writes pages to a fresh folder of the shared storage and reads the archives back."""
    out = scratch(pages.sparkSession, "warc")
    out = out if "://" in out or out.startswith("file:") else f"file://{out}"
    write(pages, out, key, url, text, least)
    return read(pages.sparkSession, out, key, pages.schema[key].dataType.simpleString())
