"""The nearest vectors of a query set among all rows: exact, by matrix products of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Queries that a task holds, vectors that it streams past them, and pairs of both that it looks at, about.
TILE_QUERIES, TILE_VECTORS, TILE_PAIRS = 1 << 15, 1 << 15, 1 << 27
#: Queries and vectors of one matrix product, and pairs whose distance is added up at once.
BLOCK_QUERIES, BLOCK_VECTORS, PAIRS = 1024, 2048, 1 << 15
#: Components up to this are multiplied; rows with others (or null, or of another length than most) are paired one by one.
LARGEST = 1e15


def nearest_vectors(vectors: DataFrame, every: int = 50, k: int = 3) -> DataFrame:
    """The k nearest vectors of a stated query set (ids divisible by `every`) among all rows, by squared distance (4 decimals), then id.

    Equal vectors are looked at as one, with the k + 1 smallest of their ids, as no query can take more of them. Tiles of queries
    and vectors meet by a shuffle; all pairs are looked at, so the work grows with the square of the different vectors.
    """
    rows = vectors.filter("vec_id IS NOT NULL").select("vec_id", "embedding")
    chosen = F.pmod("vec_id", F.lit(every)) == 0
    n, q, dim = rows.agg(F.count("*"), F.count_if(chosen), F.mode(F.when(F.col("embedding").isNotNull(), F.size("embedding")))).first()
    item = rows.schema["embedding"].dataType.elementType.simpleString()
    plain = F.coalesce((F.size("embedding") == (dim or -1)) & F.forall("embedding", lambda x: F.coalesce(F.abs(x) < LARGEST, F.lit(False))), F.lit(False)) & F.lit(item in ("float", "double"))
    found = _found(rows.filter(plain), chosen, n, q, dim or 1, np.dtype(np.float32 if item == "float" else np.float64), k)
    odd = rows.filter(~plain)
    if not odd.isEmpty():
        found = found.unionByName(_each(rows.filter(chosen), odd)).unionByName(_each(odd.filter(chosen), rows.filter(plain)))
    pairs = found.select("query_id", "vec_id", F.bround("d", 4).alias("d2"))
    order = W.partitionBy("query_id").orderBy(F.asc_nulls_last("d2"), "vec_id")
    # Spark keeps the first k of each task before the shuffle (a limit on the rank), so no task gathers all pairs of a query.
    return pairs.withColumn("rank", F.row_number().over(order).cast("long") - 1).filter(F.col("rank") < k).select("query_id", "rank", "vec_id", "d2")


def _each(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Distances of all pairs, one by one."""
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    d = F.aggregate(F.zip_with("q", "embedding", lambda a, b: (a - b).cast("double") * (a - b).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return q.join(vectors, F.col("query_id") != F.col("vec_id")).select("query_id", "vec_id", d.alias("d"))


def _found(rows: DataFrame, chosen: Column, n: int, q: int, dim: int, kind: np.dtype, k: int) -> DataFrame:
    """query_id, vec_id and squared distance d: of each query all that can be among its k nearest, a tile at a time."""
    key = rows.schema["vec_id"].dataType.simpleString()
    across = max(1, -(-q // TILE_QUERIES))
    down = max(1, -(-n // TILE_VECTORS), -(-n * min(q, TILE_QUERIES) // TILE_PAIRS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(kind) + kind.type(0)  # no -0.0
            ends = np.arange(b.num_rows + 1, dtype=np.int32) * np.int32(dim * kind.itemsize)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(x)])], names=["vec_id", "e"])

    packed = rows.mapInArrow(pack, f"vec_id {key}, e binary")
    ids = packed.groupBy("e", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("c"))
    first = ids.withColumn("r", F.row_number().over(W.partitionBy("e").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    own = first.groupBy("e").agg(F.flatten(F.collect_list(F.array_repeat("vec_id", F.col("c")))).alias("ids"))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    mine = lambda m, *c: F.pmod(F.xxhash64(*c), F.lit(m)).cast("int")
    left = packed.filter(chosen).select(F.lit(0).alias("side"), F.array("vec_id").alias("ids"), "e", mine(across, "e", "vec_id").alias("i"), every(down).alias("j"))
    right = own.select(F.lit(1).alias("side"), "ids", "e", every(across).alias("i"), mine(down, "e").alias("j"))
    tiles = left.unionByName(right).select((F.col("i") * down + F.col("j")).alias("t"), "side", "ids", "e")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, queries, tile = None, [], None

        for b in batches:
            t, side = (b.column(c).to_numpy() for c in ("t", "side"))
            cuts = [0, *(np.flatnonzero((t[1:] != t[:-1]) | (side[1:] != side[:-1])) + 1).tolist(), b.num_rows] if b.num_rows else []
            for a, z in zip(cuts, cuts[1:], strict=False):
                if t[a] != at:
                    if tile:
                        yield from tile.out(key)
                    at, queries, tile = t[a], [], None
                x = np.frombuffer(b"".join(b.column("e").slice(a, z - a).to_pylist()), kind).reshape(-1, dim)
                names = b.column("ids").slice(a, z - a)
                flat, sizes = names.flatten().to_numpy(), names.value_lengths().to_numpy()
                if side[a] == 0:
                    queries.append((flat, x))
                elif queries:
                    if tile is None:
                        tile = Tile(*(np.concatenate(y) for y in zip(*queries, strict=True)), k)
                    tile.add(flat, sizes, x)
        if tile:
            yield from tile.out(key)

    return tiles.repartitionById(across * down, F.col("t")).sortWithinPartitions("t", "side").mapInArrow(meet, f"query_id {key}, vec_id {key}, d double")


class Tile:
    """Queries, and of the vectors that went past them those that can be among the k nearest of each.

    A product tells which pairs can be near enough, with room for its error; their distance is then added up as the plain
    expression does it. Distances are compared by ten-thousandths, as the result rounds them; one that lies so near a half that
    its rounding is left to Spark is kept, and not counted.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        wide = x.astype(np.float64)
        self.square = (wide * wide).sum(1)
        self.left = np.concatenate((wide, np.ones((len(x), 1))), 1)
        self.most = np.full(len(x), np.inf)  # no farther one is among the k nearest
        self.order = np.argsort(ids, kind="stable")
        self.row, self.id, self.d = np.zeros(0, np.int64), ids[:0], np.zeros(0)

    def add(self, names: np.ndarray, sizes: np.ndarray, x: np.ndarray) -> None:
        """Vectors x, each with `sizes` of the ids `names`."""
        begins = np.cumsum(sizes) - sizes
        low, high = np.minimum.reduceat(names, begins), np.maximum.reduceat(names, begins)
        for at in range(0, len(x), BLOCK_VECTORS):
            to = min(at + BLOCK_VECTORS, len(x))
            self._block(names, begins[at:to], sizes[at:to], low[at:to], low[at:to] == high[at:to], x[at:to])

    def _block(self, names, begins, sizes, low, single, x) -> None:
        wide = x.astype(np.float64)
        square = (wide * wide).sum(1)
        right = np.concatenate((wide, -square[:, None] / 2), 1).T
        # A query is no neighbour of its own.
        a, b = (np.searchsorted(self.ids, low, s, sorter=self.order) for s in ("left", "right"))
        hit = np.flatnonzero(single & (b > a))
        own_row = np.concatenate([self.order[a[c] : b[c]] for c in hit]) if len(hit) else np.zeros(0, np.int64)
        own_column = np.repeat(hit, (b - a)[hit])
        error = 4e-15 * (x.shape[1] + 10) * (self.square + square.max())
        rows, columns = [], []
        for q in range(0, len(self.ids), BLOCK_QUERIES):
            z = min(q + BLOCK_QUERIES, len(self.ids))
            dots = self.left[q:z] @ right
            inside = (own_row >= q) & (own_row < z)
            dots[own_row[inside] - q, own_column[inside]] = -np.inf
            most = self.most[q:z]
            if len(x) >= self.k and np.isinf(most).any():
                kth = np.partition(dots, len(x) - self.k, axis=1)[:, len(x) - self.k]
                most = np.minimum(most, (self.square[q:z] - 2 * kth + error[q:z]) * (1 + 4e-7))
            reach = (np.maximum(most, 0) + 2e-4) * (1 + 4e-7) + error[q:z]
            r, c = np.nonzero(dots >= ((self.square[q:z] - reach) / 2)[:, None])
            rows.append(r + q)
            columns.append(c)
            if sum(map(len, rows)) > 1 << 20:
                self._take(np.concatenate(rows), np.concatenate(columns), names, begins, sizes, x)
                rows, columns = [], []
        if rows:
            self._take(np.concatenate(rows), np.concatenate(columns), names, begins, sizes, x)

    def _take(self, rows, columns, names, begins, sizes, x) -> None:
        d = np.zeros(len(rows))
        for at in range(0, len(rows), PAIRS):
            diff = self.x[rows[at : at + PAIRS]] - x[columns[at : at + PAIRS]]
            for i in range(diff.shape[1]):  # in this order, as the plain expression adds
                part = diff[:, i].astype(np.float64)
                d[at : at + PAIRS] += part * part
        m = sizes[columns]
        of = np.repeat(np.arange(len(rows)), m)
        name = names[np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(begins[columns], m)]
        other = name != self.ids[rows[of]]
        self.row, self.id, self.d = (np.concatenate(y) for y in ((self.row, rows[of][other]), (self.id, name[other]), (self.d, d[of][other])))
        self._prune()

    def _prune(self) -> None:
        scaled = self.d * 1e4
        floor = np.floor(scaled)
        large = self.d > 1e12  # has no more than four decimals
        sure = large | (np.abs(scaled - floor - 0.5) > 1e-6 + 1e-15 * scaled)
        step = np.where(large, scaled, floor + (scaled - floor > 0.5))
        s = np.flatnonzero(sure)
        s = s[np.lexsort((self.id[s], np.where(large, self.d, 0)[s], step[s], self.row[s]))]
        row = self.row[s]
        rank = np.arange(len(s)) - np.searchsorted(row, row)
        last = s[rank == self.k - 1]
        kth = np.full(len(self.ids), np.inf)
        kth[self.row[last]] = step[last]
        self.most[self.row[last]] = np.where(large[last], self.d[last], (step[last] + 0.5) * 1e-4)
        half = np.flatnonzero(~sure)
        keep = np.concatenate((s[rank < self.k], half[floor[half] <= kth[self.row[half]]]))
        self.row, self.id, self.d = self.row[keep], self.id[keep], self.d[keep]

    def out(self, key: str) -> Iterator[pa.RecordBatch]:
        kind = {"bigint": pa.int64(), "int": pa.int32()}[key]
        for at in range(0, len(self.row), 10_000):
            part = slice(at, at + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[self.row[part]], kind), pa.array(self.id[part], kind), pa.array(self.d[part])], names=["query_id", "vec_id", "d"])
