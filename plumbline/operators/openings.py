"""Openings in walls from empty cells of their faces; faces paired to walls; wall ends drawn to where walls meet."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import stored
from .joins import hot_join

#: Pairs that the driver looks at by itself.
LOCAL_PAIRS = 100_000


def wall_openings(points: DataFrame, walls: DataFrame, by: str, cell_m: float = 0.10, least_m: float = 0.70, most_m: float = 3.0, tall_m: float = 0.90, half_m: float | None = None) -> DataFrame:
    """Doors and windows: by, opening (its number along the wall), kind, u0, u1 (along the wall), sill_m, height_m, centre_x, centre_y.

    `points` has by, x, y, z; `walls` has by once, start_x .. end_y, base_m, height_m and thickness_m. Points beside the wall count
    for nothing. A column of cells is open if it has under 0.35 of the mean number of occupied cells, runs of open columns of a
    door's or window's width, not at a wall's end, are spans, and in a span rows with under 0.35 of its cells occupied give sill
    and height. Cells are counted by Spark; columns and rows of a wall are as many as its size has cells.
    """
    w = walls.select(by, "start_x", "start_y", "end_x", "end_y", "base_m", "height_m", "thickness_m").withColumn("len", F.hypot(F.col("end_x") - F.col("start_x"), F.col("end_y") - F.col("start_y"))).filter("len > 0")
    w = w.withColumns({"ax": (F.col("end_x") - F.col("start_x")) / F.col("len"), "ay": (F.col("end_y") - F.col("start_y")) / F.col("len"), "half": F.lit(half_m) if half_m is not None else F.greatest(F.lit(0.15), F.col("thickness_m") / 2 + 0.10)})
    own = points.select(by, "x", "y", "z").dropna()
    sizes = own.groupBy(by).agg(F.count("*").alias("size"))
    put = hot_join(own, w.join(sizes, by), by, "size", own.count(), "inner")
    ex, ey = F.col("x") - F.col("start_x"), F.col("y") - F.col("start_y")
    put = put.withColumns({"u": ex * F.col("ax") + ey * F.col("ay"), "v": ey * F.col("ax") - ex * F.col("ay"), "h": F.col("z") - F.col("base_m")})
    put = stored(put.filter("u >= 0 AND u <= len AND abs(v) <= half AND h >= 0 AND h <= height_m").select(by, "u", "h"), "faces")
    ends = put.groupBy(by).agg(F.count("*").alias("n"), F.min("u").alias("a"), F.max("u").alias("b"), F.min("h").alias("c"), F.max("h").alias("d")).filter("n >= 100 AND b > a AND d > c").join(w, by)
    ends = stored(ends.withColumns({"nu": F.greatest(F.lit(5), F.ceil(F.col("len") / cell_m)), "nz": F.greatest(F.lit(5), F.ceil(F.col("height_m") / cell_m))}), "wall_cells")
    bins = hot_join(put, ends.select(by, "a", "b", "c", "d", "nu", "nz", "n"), by, "n", put.count(), "inner")
    place = lambda x, lo, hi, m: F.least(F.col(m) - 1, F.floor((F.col(x) - F.col(lo)) / (F.col(hi) - F.col(lo)) * F.col(m)))
    full = stored(bins.groupBy(by, place("u", "a", "b", "nu").alias("iu"), place("h", "c", "d", "nz").alias("iz")).agg(F.count("*").alias("k")).filter("k > 2").select(by, "iu", "iz"), "occupied")
    every = ends.select(by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("nu").cast("long") - 1)).alias("iu"))
    columns = every.join(full.groupBy(by, "iu").agg(F.count("*").alias("k")), [by, "iu"], "left").fillna(0, ["k"])
    columns = columns.withColumn("mean", F.avg("k").over(W.partitionBy(by))).filter(F.col("k") < 0.35 * F.col("mean"))
    spans = columns.withColumn("run", F.col("iu") - F.row_number().over(W.partitionBy(by).orderBy("iu"))).groupBy(by, "run").agg(F.min("iu").alias("first"), F.max("iu").alias("last"))
    step = (F.col("b") - F.col("a")) / F.col("nu")
    spans = spans.join(ends, by).withColumns({"u0": F.col("a") + F.col("first") * step, "u1": F.col("a") + (F.col("last") + 1) * step})
    eps = 1e-9
    spans = spans.filter((F.col("last") - F.col("first") + 1 >= int(least_m / cell_m + eps)) & (F.col("u1") - F.col("u0")).between(least_m - eps, most_m + eps) & (F.col("u0") >= 0.20) & (F.col("len") - F.col("u1") >= 0.20))
    spans = stored(spans.withColumn("opening", F.row_number().over(W.partitionBy(by).orderBy("first")) - 1), "spans")
    rows = spans.select(by, "opening", "first", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nz").cast("long") - 1)).alias("iz"))
    held = rows.alias("r").join(full.alias("f"), (F.col(f"r.{by}") == F.col(f"f.{by}")) & (F.col("r.iz") == F.col("f.iz")) & F.col("f.iu").between(F.col("r.first"), F.col("r.last")), "left")
    empty = held.groupBy(F.col(f"r.{by}").alias(by), "r.opening", F.col("r.iz").alias("iz"), (F.col("r.last") - F.col("r.first") + 1).alias("wide")).agg(F.count("f.iu").alias("k")).filter(F.col("k") < 0.35 * F.col("wide"))
    found = empty.groupBy(by, "opening").agg(F.min("iz").alias("low"), F.max("iz").alias("high"), F.count("*").alias("rows")).filter(F.col("rows") >= int(tall_m / cell_m + eps)).join(spans, [by, "opening"])
    rise = (F.col("d") - F.col("c")) / F.col("nz")
    found = found.withColumns({"sill": F.col("c") + F.col("low") * rise, "top": F.col("c") + (F.col("high") + 1) * rise}).filter(F.col("top") - F.col("sill") >= tall_m - eps)
    mid = (F.col("u0") + F.col("u1")) / 2
    return found.select(by, "opening", F.when(F.col("sill") <= 0.30, "DOOR").otherwise("WINDOW").alias("kind"), *[F.bround(c, 4).alias(n) for n, c in (("u0", F.col("u0")), ("u1", F.col("u1")), ("sill_m", F.col("base_m") + F.col("sill")), ("height_m", F.col("top") - F.col("sill")), ("centre_x", F.col("start_x") + mid * F.col("ax")), ("centre_y", F.col("start_y") + mid * F.col("ay")))])


def paired(candidates: DataFrame, local_pairs: int = LOCAL_PAIRS) -> DataFrame:
    """Of candidate pairs (a < b, distance) those that come of looking at rows in order, each taking the nearest later row that is
    still free, ties to the smaller.

    What a row may take hangs on all rows before it, so the pass is one by its nature: up to `local_pairs` the driver makes it, more
    pairs are sorted and streamed through one task, which holds the rows that are taken, not the pairs.
    """
    own = stored(candidates.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("distance").cast("double").alias("distance")), "candidates")
    if own.count() > local_pairs:
        return own.repartition(1).sortWithinPartitions("a", "distance", "b").mapInArrow(_take, own.schema)
    rest = _taken(((r["a"], r["b"], r["distance"]) for r in own.orderBy("a", "distance", "b").collect()), set())
    return candidates.sparkSession.createDataFrame(list(rest), "a long, b long, distance double")


def _taken(pairs: Iterable[tuple[int, int, float]], used: set[int]) -> Iterator[tuple[int, int, float]]:
    """Of pairs in the order of a, distance and b those whose rows are both still free; `used` keeps the rows that are taken."""
    for a, b, distance in pairs:
        if a not in used and b not in used:
            used.update((a, b))
            yield a, b, distance


def _take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    used: set[int] = set()
    for batch in batches:
        found = list(_taken(zip(*(batch.column(n).to_pylist() for n in ("a", "b", "distance")), strict=True), used))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "distance"])


def snapped(walls: DataFrame, by: str, reach_m: float = 0.40, degrees: float = 45.0) -> DataFrame:
    """Walls (start_x .. end_y) with each end moved to the nearest place within reach where its line crosses another wall's line at
    that angle or more, and `moved`, how many ends were. Crossings are those of the walls as they came, so no order matters.

    A crossing within reach of an end of one wall has to be within reach of the other wall's stretch, or it would be far from both:
    candidates meet by cell of the end and of the other wall's box, widened by the reach.
    """
    rows = walls.select(by, "start_x", "start_y", "end_x", "end_y").dropna()
    size = 2.0
    low, high = lambda a: F.least(f"start_{a}", f"end_{a}") - reach_m, lambda a: F.greatest(f"start_{a}", f"end_{a}") + reach_m
    cells = rows.select(F.col(by).alias("other"), F.col("start_x").alias("x3"), F.col("start_y").alias("y3"), F.col("end_x").alias("x4"), F.col("end_y").alias("y4"), F.explode(F.sequence(F.floor(low("x") / size), F.floor(high("x") / size))).alias("gx"), F.sequence(F.floor(low("y") / size), F.floor(high("y") / size)).alias("gys")).withColumn("gy", F.explode("gys")).drop("gys")
    ends = rows.select(by, F.col("start_x").alias("x1"), F.col("start_y").alias("y1"), F.col("end_x").alias("x2"), F.col("end_y").alias("y2"), F.explode(F.array(F.struct(F.lit("start").alias("end"), F.col("start_x").alias("x"), F.col("start_y").alias("y")), F.struct(F.lit("end").alias("end"), F.col("end_x").alias("x"), F.col("end_y").alias("y")))).alias("e")).select("*", "e.*").drop("e")
    spread = F.array(*[F.struct(F.lit(i * reach_m).alias("i"), F.lit(j * reach_m).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = ends.withColumn("g", F.explode(F.array_distinct(F.transform(spread, lambda s: F.struct(F.floor((F.col("x") + s["i"]) / size).alias("gx"), F.floor((F.col("y") + s["j"]) / size).alias("gy")))))).select("*", "g.*").drop("g")
    turn = lambda x1, y1, x2, y2: F.pmod(F.degrees(F.atan2(F.col(y2) - F.col(y1), F.col(x2) - F.col(x1))), F.lit(180.0))
    apart = F.abs(turn("x1", "y1", "x2", "y2") - turn("x3", "y3", "x4", "y4"))
    den = (F.col("x1") - F.col("x2")) * (F.col("y3") - F.col("y4")) - (F.col("y1") - F.col("y2")) * (F.col("x3") - F.col("x4"))
    d1, d2 = F.col("x1") * F.col("y2") - F.col("y1") * F.col("x2"), F.col("x3") * F.col("y4") - F.col("y3") * F.col("x4")
    pairs = near.join(cells, ["gx", "gy"]).filter(F.col(by) != F.col("other")).filter((F.least(apart, 180 - apart) >= degrees) & (F.abs(den) >= 1e-8))
    pairs = pairs.withColumns({"px": (d1 * (F.col("x3") - F.col("x4")) - (F.col("x1") - F.col("x2")) * d2) / den, "py": (d1 * (F.col("y3") - F.col("y4")) - (F.col("y1") - F.col("y2")) * d2) / den})
    pairs = pairs.withColumn("off", F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y"))).filter(F.col("off") <= reach_m)
    inside = (F.col("px").between(F.least("x3", "x4") - reach_m, F.greatest("x3", "x4") + reach_m)) & (F.col("py").between(F.least("y3", "y4") - reach_m, F.greatest("y3", "y4") + reach_m))
    best = pairs.filter(inside).groupBy(by, "end").agg(F.min(F.struct("off", "other", "px", "py")).alias("m"))
    wide = best.groupBy(by).pivot("end", ["start", "end"]).agg(F.first("m"))
    out = walls.join(wide, by, "left")
    new = {f"{e}_{a}": F.coalesce(F.col(f"{e}.p{a}"), F.col(f"{e}_{a}")) for e in ("start", "end") for a in "xy"}
    return out.withColumns(new | {"moved": F.col("start").isNotNull().cast("int") + F.col("end").isNotNull().cast("int")}).drop("start", "end")
