"""What the operators of this subpackage share: tables, shared storage and Arrow row maps."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import scratch, shared_dir
from ..storage import stored as _stored

#: Text handled at once by a Python worker, in bytes. A longer text is handled alone.
BLOCK_BYTES = 1 << 19
#: Rows and bytes of an Arrow batch between Spark and its workers. Spark's defaults (10,000 rows, 64 MB) hold several times
#: more in the executor's and the worker's memory than a block.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
__all__ = ["fields", "filter_text", "fold", "lean", "map_text", "pieces", "scratch", "shared_dir", "stored", "table", "trim", "trimmed"]

ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, k: int) -> Column:
    """crc32 of the key as text, modulo k; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % k


def lean(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, unless it has bounds of its own. Read when a query is planned, so they are left set."""
    for name, default, ours in (("maxRecordsPerBatch", "10000", str(BATCH_ROWS)), ("maxBytesPerBatch", "67108864b", f"{BATCH_BYTES}b")):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", ours) == default:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", ours)


def stored(df: DataFrame, name: str) -> DataFrame:
    lean(df.sparkSession)
    return _stored(df, name)


def fields(ddl: str) -> list[T.StructField]:
    return list(T._parse_datatype_string(ddl).fields)


def trim() -> None:
    """Gives freed memory back to the system: a worker that waits for its next task should not hold that of its last."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, after which a worker gives back what it held: idle workers count to their executor's memory, beside those that work."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return f


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into slices whose texts have about `limit` bytes or are a single row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
    trim()


def map_text(df: DataFrame, text: str, keep: list[str], ddl: str, make: Callable[[], Callable[[pa.StringArray], list]], limit: int = BLOCK_BYTES) -> DataFrame:
    """Keeps the columns `keep` and adds the columns of `ddl`, one value a row.

    `make` is called once a task; what it returns gets the texts of a slice (nulls stay null) and
    returns one list or Arrow array for each added column. No shuffle, memory bounded by the slice.
    """
    lean(df.sparkSession)
    added = fields(ddl)
    names = [*keep, *[f.name for f in added]]
    if len(set(names)) < len(names):
        raise ValueError(f"columns clash: {names}")
    schema = T.StructType([df.schema[c] for c in keep] + added)
    kinds = [ARROW[f.dataType.simpleString()] for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for piece in pieces(batches, text, limit):
            out = [x if isinstance(x, pa.Array) and x.type == k else pa.array(x, k) for x, k in zip(f(piece.column(text)), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in keep], *out], names=names)

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def filter_text(df: DataFrame, text: str, make: Callable[[], Callable[[pa.StringArray], list]]) -> DataFrame:
    """The rows of df, all columns as they are, whose texts get a true value from `make`'s function."""
    lean(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for piece in pieces(batches, text):
            yield piece.filter(pa.array(f(piece.column(text)), pa.bool_()))

    return df.mapInArrow(run, df.schema)
