"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters, each pair verified once.

Texts with the same set of shingles form a class, which is joined once. Pairs that are already known to be in one
component are not looked for again: a shingle that very many classes share links them to one of them first, and only
members that are still apart then meet each other, in tiles. So no link between components is lost, and copies in their
thousands make no pairs of their own. Links inside a component are counted at its end, class by class in tiles, so that
each row has the number of its links though no pair is written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components
from ..operators.joins import hot_join
from .common import pieces, stored, trimmed
from .textops import NONSPACE, U, mix, words

#: Buckets of the table of shingle counts that orders shingles rare-first. Any table gives right results; it has a fixed size.
BITS = 20
SKETCH = 1 << BITS
#: Buckets of that table whose counts go in one row, and bytes of sets or postings that go in one Arrow batch.
CHUNK, SENT_BYTES = 1 << 13, 2 << 20
#: Postings that one task of the prefix join takes, about.
POSTINGS = 300_000
#: Members of a shared prefix shingle that meet in pairs at once; more are linked to their first member first.
CROWD = 8
#: Rows of two keys each that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Rows of a shingle, by the table, above which it is dealt out over several tasks, and members of a tile.
HOT, TILE = 100_000, 2048
#: Classes, and shingles, of a component that meet at once when its links are counted; and columns of a block of their matrix.
LINK_TILE, LINK_SHINGLES, LINK_COLUMNS = 256, 1 << 20, 4096
#: Cells of the histograms by which the suffix filter bounds the overlap. A cell that holds FULL is not counted on.
CELLS, FULL = 128, 255

_FACTORS = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0x27D4EB2F165667C5), U(0x85EBCA77C2B2AE63)]


def shingle_sets(texts: pa.StringArray, n: int) -> list[np.ndarray]:
    """The sorted distinct shingles of n words of each text as 64-bit hashes; with fewer words the whole sequence as one, without none."""
    h, first = words(texts, NONSPACE)
    m = max(0, len(h) - n + 1)
    c = h[:m] * _FACTORS[0]
    for i in range(1, n):
        c = (c ^ (c >> U(29))) * _FACTORS[(i + 1) % 5] + h[i : m + i] * _FACTORS[i % 5]
    c = mix(c)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(c[a : b - n + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            x = np.array([b - a], U)
            for w in h[a:b]:
                x = mix(x * _FACTORS[0] + w)
            out.append(x)
        else:
            out.append(c[:0])
    return out


def mark(s: np.ndarray) -> int | None:
    """64 bits that name a set of shingles; None for the empty set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None


def least_overlap(n: int, num: int, den: int) -> int:
    """Shingles that a set of n shares at least with any set it links with."""
    return -(-n * num // den)


def profile(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """Rows of kind 0: k, h (xxhash64 of the text), set (its name) and n (its size), one for each row; of kind 1: set (number of a chunk of buckets) and counts (places in it, two bytes each, then the rows that hold their shingles, four each).

    A task counts in one table, so packed counts spare Spark a row for each of its 2^20 buckets.
    """
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("k", docs.schema[key].dataType), T.StructField("h", T.LongType()), T.StructField("set", T.LongType()), T.StructField("n", T.LongType()), T.StructField("counts", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(SKETCH, np.int64)
        kind = None
        for batch in batches:
            for b in pieces(iter([batch]), "t"):
                kind = b.column("k").type
                sets = shingle_sets(b.column("t"), n)
                if sets:
                    count += np.bincount((np.concatenate(sets) >> U(64 - BITS)).astype(np.int64), minlength=SKETCH)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int32)), b.column("k"), b.column("h"), pa.array([mark(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.nulls(len(sets), pa.binary())], names=schema.names)
        while count.any():
            now = np.minimum(count, 0xFFFFFFFF)
            count -= now
            for first in range(0, SKETCH, 16 * CHUNK):
                rows = [(i // CHUNK, _packed(now[i : i + CHUNK])) for i in range(first, first + 16 * CHUNK, CHUNK) if now[i : i + CHUNK].any()]
                if rows:
                    at, packed = zip(*rows, strict=True)
                    m = len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.nulls(m, kind), pa.nulls(m, pa.int64()), pa.array(at, pa.int64()), pa.nulls(m, pa.int64()), pa.array(packed, pa.binary())], names=schema.names)

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h")).mapInArrow(trimmed(run), schema)


def _packed(counts: np.ndarray) -> bytes:
    """The counts of a chunk that are not 0: their places, then they."""
    at = np.flatnonzero(counts)
    return at.astype(np.uint16).tobytes() + counts[at].astype(np.uint32).tobytes()


def _counts(rows: DataFrame) -> np.ndarray:
    """Rows of each bucket, from rows (set, counts): summed by tasks and packed there, so that the driver gets 8 bytes a bucket."""
    size = 1 << 16

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = np.zeros(size, np.int64), None
        for b in batches:
            for chunk, x in zip(b.column("set").to_pylist(), b.column("counts").to_pylist(), strict=True):
                part, first, m = chunk * CHUNK // size, chunk * CHUNK % size, len(x) // 6
                table[first + np.frombuffer(x, np.uint16, m).astype(np.int64)] += np.frombuffer(x, np.uint32, m, 2 * m)
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([table.tobytes()], pa.binary())], names=["part", "n"])

    counts = np.zeros(SKETCH, np.int64)
    for r in rows.repartitionById(SKETCH // size, F.floor(F.col("set") * CHUNK / size).cast("int")).mapInArrow(trimmed(pack), "part int, n binary").collect():
        counts[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["n"], np.int64)
    return counts


def postings(docs: DataFrame, key: str, text: str, n: int, num: int, den: int, counts: np.ndarray, parts: int) -> DataFrame:
    """Prefix postings packed by part: part, and binary keys, nodes, sizes and places; beside them rows without keys: nodes and their histograms.

    Places are inverted for shingles that are dealt out over several parts. A text whose set the task has met before adds nothing. Shingles are in the order of their bucket's count, rare first.
    """
    spark = docs.sparkSession
    hot = np.flatnonzero(counts >= HOT)
    shared = spark.sparkContext.broadcast((np.minimum(255, 8 * np.log2(1.0 + counts)).astype(np.uint8), hot, 1 + counts[hot] // HOT))
    schema = T._parse_datatype_string("part int, keys binary, nodes binary, sizes binary, places binary")
    names = schema.names
    kinds = [pa.int32(), *[pa.binary()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, hot, parts_of_hot = shared.value
        seen: set[int] = set()
        held: list[tuple] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            k, v, s, p, part = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(part, kind="stable")
            k, v, s, p, part = k[order], v[order], s[order], p[order], part[order]
            at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            rows, sent = [], 0
            for a, b in zip(at, [*at[1:], len(part)], strict=True):
                rows.append((int(part[a]), k[a:b].tobytes(), v[a:b].tobytes(), s[a:b].tobytes(), p[a:b].tobytes()))
                sent += 24 * int(b - a)
                if sent > SENT_BYTES or b == len(part):
                    yield _batch(rows, names, kinds)
                    rows, sent = [], 0

        for batch in batches:
            for b in pieces(iter([batch]), "t"):
                cells = []
                for s in shingle_sets(b.column("t"), n):
                    m = mark(s)
                    if m is None or m in seen:
                        continue
                    if len(seen) >= 1 << 20:
                        seen.clear()
                    seen.add(m)
                    bucket = (s >> U(64 - BITS)).astype(np.int64)
                    prefix = len(s) - least_overlap(len(s), num, den) + 1
                    first = np.argsort(rank[bucket], kind="stable")[:prefix]
                    k = s[first]
                    salt = np.ones(prefix, np.int64)
                    if len(hot):
                        i = np.minimum(np.searchsorted(hot, bucket[first]), len(hot) - 1)
                        salt = np.where(hot[i] == bucket[first], parts_of_hot[i], 1)
                    place = np.arange(prefix, dtype=np.int32)
                    place[salt > 1] = ~place[salt > 1]  # dealt out: its members meet in apart()
                    deal = mix(k + U(m & 0xFFFFFFFFFFFFFFFF) % salt.astype(U)) if salt.max() > 1 else k
                    held.append((k, np.full(prefix, m, np.int64), np.full(prefix, len(s), np.int32), place, ((deal >> U(20)) % U(parts)).astype(np.int32)))
                    size += prefix
                    cells.append((m, np.minimum(np.bincount((s & U(CELLS - 1)).astype(np.int64), minlength=CELLS), FULL).astype(np.uint8)))
                if cells:
                    yield pa.RecordBatch.from_arrays([pa.array([cells[0][0] % parts], pa.int32()), pa.nulls(1, pa.binary()), pa.array([np.array([c[0] for c in cells], np.int64).tobytes()], pa.binary()), pa.nulls(1, pa.binary()), pa.array([b"".join(c[1].tobytes() for c in cells)], pa.binary())], names=names)
                if size > 2 * POSTINGS:
                    yield from out()
                    size = 0
        if held:
            yield from out()

    return docs.select(F.col(text).alias("t")).mapInArrow(trimmed(run), schema)


def possible(n1: np.ndarray, n2: np.ndarray, p1: np.ndarray, p2: np.ndarray, num: int, den: int) -> np.ndarray:
    """Length and positional filter: whether sets of these sizes, that share the shingle at these places of theirs, can link.

    At most min(p1, p2) shingles are shared before it and the smaller rest after it.
    """
    need = -(-(n1 + n2) * num // (num + den))
    most = np.minimum(p1, p2) + 1 + np.minimum(n1 - p1, n2 - p2) - 1
    return (np.minimum(n1, n2) * den >= np.maximum(n1, n2) * num) & (most >= need)


_MET = "kind int, a long, b long, n long, p long, cells binary"


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distinct pairs, smaller first, as rows."""
    x = np.stack([np.minimum(a, b), np.maximum(a, b)], 1)
    x = x[x[:, 0] != x[:, 1]]
    order = np.lexsort((x[:, 1], x[:, 0]))
    x = x[order]
    return x[np.concatenate(([True], (x[1:] != x[:-1]).any(1)))] if len(x) else x


def met(packed: DataFrame, parts: int, num: int, den: int) -> DataFrame:
    """Rows of kind 0: candidate pairs (a, b). Of kind 1: member a of crowd b (the shingle), its size n and place p. Of kind 2: node a and its histogram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[1] is None:
                    v = np.frombuffer(r[2], np.int64)
                    yield _met(2, v, *[np.zeros(len(v), np.int64)] * 3, cells=[r[4][i * CELLS : (i + 1) * CELLS] for i in range(len(v))])
                else:
                    held.setdefault(r[0], []).append(r[1:])
        for part in list(held):
            rows = held.pop(part)
            k, v, s, p = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*rows, strict=True), (np.uint64, np.int64, np.int32, np.int32), strict=True))
            order = np.lexsort((v, k))
            k, v, s, p = k[order], v[order], s[order].astype(np.int64), p[order].astype(np.int64)
            new = np.concatenate(([True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])))
            k, v, s, p = k[new], v[new], s[new], p[new]
            at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            run_size = np.diff(np.append(at, len(k)))
            crowd = np.repeat(run_size > CROWD, run_size) | (p < 0)
            few = ~crowd & np.repeat(run_size > 1, run_size)
            p = np.where(p < 0, ~p, p)
            x = [z[few] for z in (k, v, s, p)]
            found = []
            for d in range(1, CROWD):
                i = np.flatnonzero(x[0][d:] == x[0][:-d])
                if not len(i):
                    break
                ok = possible(x[2][i], x[2][i + d], x[3][i], x[3][i + d], num, den)
                found.append((x[1][i[ok]], x[1][i[ok] + d]))
            # In a crowd each member meets that with the fewest rarer shingles, most like a common original, of about its
            # size, and that of the next larger sizes.
            if crowd.any():
                x = [z[crowd] for z in (k, v, s, p)]
                band = np.floor(np.log(x[2]) / np.log(den / num)).astype(np.int64)
                order = np.lexsort((x[1], x[3], band, x[0]))
                x = [z[order] for z in x]
                band = band[order]
                begin = np.flatnonzero(np.concatenate(([True], (x[0][1:] != x[0][:-1]) | (band[1:] != band[:-1]))))
                own = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(band))))
                for step in (0, 1):
                    i = np.flatnonzero(own + step < len(begin))
                    head = begin[own[i] + step]
                    i, head = (z[(x[0][i] == x[0][head]) & (band[i] + step == band[head])] for z in (i, head))
                    ok = possible(x[2][i], x[2][head], x[3][i], x[3][head], num, den)
                    found.append((x[1][i[ok]], x[1][head[ok]]))
                yield _met(1, x[1], x[0].view(np.int64), x[2], x[3])
            if found:
                pairs = _pairs(*(np.concatenate(z) for z in zip(*found, strict=True)))
                yield _met(0, pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64))

    return packed.repartitionById(parts, F.col("part")).mapInArrow(trimmed(run), _MET)


def _met(kind: int, *columns: np.ndarray, cells: list[bytes] | None = None) -> pa.RecordBatch:
    n = len(columns[0])
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *[pa.array(c) for c in columns], pa.array(cells, pa.binary()) if cells is not None else pa.nulls(n, pa.binary())], names=["kind", "a", "b", "n", "p", "cells"])


def near(x: np.ndarray, y: np.ndarray, n1: np.ndarray, n2: np.ndarray, num: int, den: int) -> np.ndarray:
    """Suffix filter: whether the histograms (rows of CELLS) leave room for the overlap that a link needs."""
    most = np.minimum(x, y).sum(1, dtype=np.int64)
    full = ((x == FULL) & (y == FULL)).any(1)
    return full | (most >= -(-(n1 + n2) * num // (num + den)))


def close(pairs: DataFrame, cells: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that pass the suffix filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, CELLS) for c in ("x", "y"))
            ok = near(x, y, b.column("m").to_numpy(), b.column("n").to_numpy(), num, den)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok))

    one, two = (cells.select(F.col("node").alias(c), F.col("cells").alias(d), F.col("n").alias(m)) for c, d, m in (("a", "x", "m"), ("b", "y", "n")))
    return stored(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y", "m", "n").mapInArrow(trimmed(run), "a long, b long"), "candidates")


def small(df: DataFrame) -> DataFrame:
    """The stored rows, to be broadcast if there are at most BROADCAST_ROWS of them, else to be joined by a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def opened(s: bytes) -> np.ndarray:
    out = np.zeros((len(s) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(s, np.uint8).reshape(-1, 6)
    return out.view(U)[:, 0]


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, key: str, text: str, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link: one look at both whole sets for each pair.

    The set of the node with fewer pairs is sent to the other, whose own comes once: 48 bits a shingle, straight from one text
    of each class. Which texts are wanted is broadcast where that is small, so that texts themselves need no shuffle.
    """
    degree = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    both = pairs.join(degree.select(F.col("node").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("node").alias("b"), F.col("d").alias("db")), "b")
    turn = F.col("da") > F.col("db")
    turned = stored(both.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b"), F.least("da", "db").alias("d")), "turned")
    of = classes.select(F.col("set").alias("node"), "h", "k")
    texts = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))

    def found(wanted: DataFrame, name: str) -> DataFrame:
        w = small(stored(wanted, name)).alias("w")
        return texts.join(w, texts["k"].eqNullSafe(F.col("w.k")) & (texts["h"] == F.col("w.h"))).select("w.node", "w.to", "t")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # a text that is there again and again is sent once by a task
        for batch in batches:
            for b in pieces(iter([batch]), "t"):
                rows, sent = [], 0
                for v, others, s in zip(b.column("node").to_pylist(), b.column("to").to_pylist(), shingle_sets(b.column("t"), n), strict=True):
                    if mark(s) == v and (v, others[0]) not in seen:
                        if len(seen) >= 1 << 18:
                            seen.clear()
                        seen.add((v, others[0]))
                        packed = (s >> U(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
                        for other in others:
                            rows.append((v, other, packed))
                            sent += len(packed) + 40
                            if sent > SENT_BYTES:
                                yield _batch(rows, ["a", "b", "s"], _SET)
                                rows, sent = [], 0
                if rows:
                    yield _batch(rows, ["a", "b", "s"], _SET)

    # A node's partners are sent for in lists of a bounded length.
    sent = turned.groupBy(F.col("a").alias("node"), F.pmod(F.xxhash64("b"), F.ceil(F.col("d") / 64)).alias("r")).agg(F.collect_list("b").alias("to")).drop("r").join(of, "node")
    own = turned.select(F.col("b").alias("node")).distinct().join(of, "node").withColumn("to", F.array("node"))
    left = found(sent, "sent").mapInArrow(trimmed(sets), "a long, b long, s binary").select("a", "b", F.col("s").alias("x"))
    right = stored(found(own, "own").mapInArrow(trimmed(sets), "a long, b long, s binary").select("b", F.col("s").alias("y")).dropDuplicates(["b"]), "heads")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for s, t in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                z = np.concatenate((opened(s), opened(t)))
                z.sort(kind="stable")
                common = int(np.count_nonzero(z[1:] == z[:-1]))
                ok.append(den * common >= num * (len(z) - common))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    # Repeated rows of a text may give a pair once for each task, which components do not mind.
    return stored(left.join(right, "b").select("a", "b", "x", "y").mapInArrow(trimmed(run), "a long, b long"), "linked")


def apart(crowds: DataFrame, known: DataFrame, cells: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of crowd members that are still in different components and can link.

    In each crowd all that are outside its largest component meet all members, in tiles of TILE by TILE. Of the crowds that
    two share, only that with the smallest name looks at them; what passes the suffix filter there comes out, once.
    """
    members = crowds.select(F.col("b").alias("crowd"), F.col("a").alias("node"), "n", "p").dropDuplicates(["crowd", "node"]).join(known, "node", "left").withColumn("c", F.coalesce("root", "node")).drop("root")
    sizes = members.groupBy("crowd", "c").agg(F.count("*").alias("m")).groupBy("crowd").agg(F.sum("m").alias("all"), F.max("m").alias("most"), F.max_by("c", "m").alias("main"), F.count("*").alias("k")).filter("k > 1")
    sizes = sizes.select("crowd", "main", F.ceil(F.col("all") / TILE).cast("int").alias("js"), F.ceil((F.col("all") - F.col("most")) / TILE).cast("int").alias("is"))
    split = stored(members.join(sizes, "crowd"), "split")
    lists = split.groupBy("node").agg(F.collect_list("crowd").alias("crowds")).join(cells, "node")
    own = split.join(lists, "node").withColumn("crowds", F.expr("filter(crowds, x -> x < crowd)"))
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    out = own.filter("c <> main").withColumn("i", mine("is")).withColumn("j", every("js")).withColumn("out", F.lit(True))
    tiled = out.unionByName(own.withColumn("i", every("is")).withColumn("j", mine("js")).withColumn("out", F.lit(False)))

    def meet(table: pa.Table) -> pa.Table:
        v, s, p, c, main = (table.column(x).to_numpy() for x in ("node", "n", "p", "c", "main"))
        out = table.column("out").to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0, bool)
        h = np.frombuffer(b"".join(table.column("cells").to_pylist()), np.uint8).reshape(-1, CELLS)
        lists = table.column("crowds").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        names = lists.flatten().to_numpy()
        of = np.repeat(np.arange(len(v)), np.diff(lists.offsets.to_numpy()))
        which, place = np.unique(names, return_inverse=True)
        bits = np.zeros((len(v), max(1, len(which))), bool)
        bits[of, place] = True
        bits = np.packbits(bits, axis=1)
        right = np.flatnonzero(~out)
        found = []
        for i in np.flatnonzero(out).tolist():
            j = right[(c[right] != c[i]) & ((c[right] == main[i]) | (v[i] < v[right]))]
            j = j[possible(s[j], s[i], p[j], p[i], num, den)]
            j = j[~(bits[j] & bits[i]).any(1)]
            j = j[near(h[j], h[i], s[j], s[i], num, den)]
            found.append((np.full(len(j), v[i]), v[j]))
        x = _pairs(*(np.concatenate(z) for z in zip(*found, strict=True))) if found else np.zeros((0, 2), np.int64)
        return pa.table({"a": x[:, 0], "b": x[:, 1]})

    return tiled.select("crowd", "i", "j", "node", "n", "p", "c", "main", "out", "cells", "crowds").groupBy("crowd", "i", "j").applyInArrow(meet, "a long, b long").distinct()


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of these sorted sets share, in blocks of columns of their 0/1 matrix."""
    m = len(sets)
    values = np.concatenate(sets)
    of = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, of = values[order], of[order]
    new = np.concatenate(([True], values[1:] != values[:-1]))
    twice = np.concatenate((~new[1:], [False])) | ~new  # an element of one set alone is shared with none
    column = np.cumsum(new[twice]) - 1
    of = of[twice]
    out = np.zeros((m, m), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, LINK_COLUMNS):
        a, b = np.searchsorted(column, (at, at + LINK_COLUMNS))
        block = np.zeros((m, LINK_COLUMNS), np.float32)
        block[of[a:b], column[a:b] - at] = 1
        out += block @ block.T
    return out.astype(np.int64)


def link_counts(members: DataFrame, docs: DataFrame, key: str, text: str, n: int, num: int, den: int) -> DataFrame:
    """(set, links): how many rows have a text that links with this class's, but another set.

    `members` has set, k, h (a text of the class), n, c (rows of the class) and root of all classes in components of several. A
    component's classes are dealt over buckets of about LINK_TILE classes and LINK_SHINGLES shingles; every two buckets meet
    in a tile. Tiles are sorted streams, of which a task holds one at a time.
    """
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / LINK_TILE), F.ceil(F.sum("n") / LINK_SHINGLES), F.lit(1)).cast("int").alias("tiles"), F.count("*").alias("m"))
    total = members.count()
    wanted = hot_join(members, sizes, "root", "m", total, "inner").withColumn("mine", F.pmod(F.xxhash64("set"), F.col("tiles")).cast("int"))
    w = small(stored(wanted, "linking")).alias("w")
    texts = docs.select(F.col(key).alias("__k"), F.xxhash64(text).alias("__h"), F.col(text).alias("t"))
    found = texts.join(w, texts["__k"].eqNullSafe(F.col("w.k")) & (texts["__h"] == F.col("w.h"))).select("w.set", "w.c", "w.root", "w.tiles", "w.mine", "t")
    names = ["root", "i", "j", "set", "c", "mine", "s"]

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a text that is there again and again is sent once by a task
        for batch in batches:
            for b in pieces(iter([batch]), "t"):
                out = []
                for v, c, root, tiles, mine, s in zip(*(b.column(x).to_pylist() for x in ("set", "c", "root", "tiles", "mine")), shingle_sets(b.column("t"), n), strict=True):
                    if mark(s) == v and v not in seen:
                        if len(seen) >= 1 << 18:
                            seen.clear()
                        seen.add(v)
                        packed = (s >> U(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
                        out += [(root, min(mine, o), max(mine, o), v, c, mine, packed) for o in range(tiles)]
                        if len(out) * (len(packed) + 40) > 4 << 20:
                            yield _batch(out, names, _SENT)
                            out = []
                if out:
                    yield _batch(out, names, _SENT)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, done = None, {}, []

        def close() -> None:
            keys = list(held)
            if len(keys) < 2:
                return
            c = np.array([held[k][0] for k in keys], np.int64)
            mine = np.array([held[k][1] for k in keys])
            sets = [np.sort(opened(held[k][2])) for k in keys]
            size = np.array([len(s) for s in sets], np.int64)
            common = shared_counts(sets)
            links = den * common >= num * (size[:, None] + size[None, :] - common)
            np.fill_diagonal(links, False)
            if tile[1] != tile[2]:  # classes of one bucket meet in their own tile
                links &= mine[:, None] != mine[None, :]
            done.extend(zip(keys, (links @ c).tolist(), strict=True))

        for b in batches:
            for root, i, j, v, c, mine, s in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if (root, i, j) != tile:
                    close()
                    tile, held = (root, i, j), {}
                held[v] = (c, mine, s)  # a repeated row of the text counts once
            if len(done) > 10_000:
                yield _batch(done, ["set", "links"], (pa.int64(), pa.int64()))
                done = []
        close()
        if done:
            yield _batch(done, ["set", "links"], (pa.int64(), pa.int64()))

    dealt = found.mapInArrow(trimmed(sent), "root long, i int, j int, set long, c long, mine int, s binary")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // 20_000)
    tiles = dealt.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j")
    return tiles.mapInArrow(trimmed(counted), "set long, links long").groupBy("set").agg(F.sum("links").alias("links"))


_SET = (pa.int64(), pa.int64(), pa.binary())
_SENT = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())


def _batch(rows: list[tuple], names: list[str], kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 8, den: int = 10, links: bool = True) -> DataFrame:
    """One row for each row of docs: k (the key), h (xxhash64 of the text), n_shingles, root (its component's name), component_id, n_links.

    Two texts link when den * common >= num * all of their distinct shingles of n words, which are found exactly (but for
    equal hashes: 64 bits, 48 in verification). component_id is the smallest key reachable by links, its own included; rows that
    share a key are one document. n_links counts the other rows that this row's text links with, copies included (null
    unless `links`). A text without words is empty, links with nothing and has no root. Null keys never are the smallest: a
    component of null keys alone has none. Repeated rows give repeated results; an empty table gives none.
    """
    rows = stored(profile(docs, key, text, n), "profile")
    named = rows.filter("kind = 0").drop("kind", "counts")
    counts = _counts(rows.filter("kind = 1").select("set", "counts"))
    classes = stored(named.filter("set IS NOT NULL").groupBy("set").agg(F.min(F.struct(F.col("k").isNull().alias("no"), "k", "h")).alias("x"), F.max("n").alias("n"), F.count("*").alias("c")).select("set", "x.k", "x.h", "n", "c"), "classes")
    total, n_rows, n_classes = classes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    parts = max(8, -(-total * (den - num) // (den * POSTINGS)))
    found = stored(met(postings(docs, key, text, n, num, den, counts, parts), parts, num, den), "met")
    cells = found.filter("kind = 2").select(F.col("a").alias("node"), "cells").dropDuplicates(["node"]).join(classes.select(F.col("set").alias("node"), "n"), "node")
    crowds = found.filter("kind = 1")
    same_key = named.filter("k IS NOT NULL AND set IS NOT NULL").groupBy("k").agg(F.min("set").alias("a"), F.max("set").alias("b"), F.collect_set("set").alias("sets")).filter("a <> b").select("a", F.explode("sets").alias("b"))
    pairs = close(found.filter("kind = 0").select("a", "b").distinct(), cells, num, den)
    check = lambda pairs: verified(pairs, docs, classes, key, text, n, num, den)
    known = stored(components(check(pairs).unionByName(same_key)), "components")
    if not crowds.isEmpty():
        more = stored(apart(crowds, known, cells.select("node", "cells"), num, den), "apart")
        if not more.isEmpty():
            # Components are nodes now; what the first links joined stays joined.
            again = check(more).join(known.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(known.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
            joined = again.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
            known = stored(components(joined.unionByName(known.select(F.col("node").alias("a"), F.col("root").alias("b")))), "components")
    rooted = classes.join(known.withColumnRenamed("node", "set"), "set", "left").withColumn("alone", F.col("root").isNull()).withColumn("root", F.coalesce("root", "set"))
    first = rooted.groupBy("root").agg(F.min("k").alias("component_id"), F.count("*").alias("m"))
    member = stored(hot_join(rooted, first, "root", "m", n_classes), "classes_rooted")
    if links:
        counted = link_counts(member.filter("NOT alone").select("set", "k", "h", "n", "c", "root"), docs, key, text, n, num, den)
        member = member.join(counted, "set", "left").withColumn("n_links", F.col("c") - 1 + F.coalesce("links", F.lit(0)))
    else:
        member = member.withColumn("n_links", F.lit(None).cast("long"))
    table = stored(member.select("set", "root", "component_id", "n_links", "c"), "classes_linked")
    out = hot_join(named.withColumnRenamed("n", "n_shingles"), table, "set", "c", n_rows)
    none = F.lit(0) if links else F.lit(None)
    return out.select("k", "h", "n_shingles", "root", F.when(F.col("root").isNull(), F.col("k")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", none).cast("long").alias("n_links"))


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """key, n_shingles, component_id, n_links of each row; see groups()."""
    return groups(docs, key, text, n, num, den).select(F.col("k").alias(key), "n_shingles", "component_id", "n_links")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The rows of docs, all columns kept, that stay when of each component only the one with the smallest key does.

    Of repeated rows of that key one stays. Texts without words all stay, and of a component of null keys one stays.
    """
    found = stored(groups(docs, key, text, n, num, den, links=False), "groups")
    stays = found.filter("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("k").isNull().alias("no"), "k", "h")).alias("x"), F.count("*").alias("c"))
    chosen = stays.select("root", F.col("x.k").alias("k0"), F.col("x.h").alias("h0"), "c")
    gone = stored(hot_join(found, chosen, "root", "c", found.count(), "inner").filter(~(F.col("k").eqNullSafe(F.col("k0")) & (F.col("h") == F.col("h0")))).select(F.col("k").alias("__k"), F.col("h").alias("__g")).distinct(), "gone")
    again = not found.filter("root IS NOT NULL").groupBy("k", "h").count().filter("count > 1").isEmpty()
    rows = docs.withColumn("__h", F.xxhash64(text))
    left = rows.join(small(gone), F.col(key).eqNullSafe(F.col("__k")) & (F.col("__h") == F.col("__g")), "left_anti")
    if again:
        empty = left.filter(F.coalesce(F.length(F.regexp_replace(text, "[\\x20\\x09-\\x0D]", "")), F.lit(0)) == 0)
        full = left.filter(F.coalesce(F.length(F.regexp_replace(text, "[\\x20\\x09-\\x0D]", "")), F.lit(0)) > 0).dropDuplicates([key, "__h"])
        left = full.unionByName(empty)
    return left.drop("__h")
