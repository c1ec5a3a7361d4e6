"""Service networks: terminals, chains of cylinders, junctions, hosting, zones between walls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from . import spatial
from .components import components


def terminals(elements: DataFrame, radius_mm: float = 1500.0) -> DataFrame:
    """The nearest carrier within the radius of each terminal."""
    t = elements.filter(F.col("element_type").isin("sprinkler", "valve", "smoke_detector", "strainer", "expansion_joint")).select("k", "cx", "cy", "cz")
    c = elements.filter(F.col("element_type").isin(*spatial.CARRIERS)).select(F.col("k").alias("carrier"), "cx", "cy", "cz")
    return spatial.nearest_within(t, c, "k", "carrier", radius_mm).select("k", "carrier", F.bround("distance", 3).alias("distance_mm"))


def cylinder_chains(segments: DataFrame, gap_mm: float = 1000.0, radius_part: float = 0.2) -> DataFrame:
    """Upright cylinders of about one radius whose axes meet and whose ends are near become one: components of such pairs."""
    own = segments.filter("shape = 'cylinder'").withColumn("radius", E.extent("x") / 2)
    pairs = spatial.box_pairs(own, own, gap_mm).filter("a.k < b.k")
    off = F.sqrt((F.col("a.cx") - F.col("b.cx")) ** 2 + (F.col("a.cy") - F.col("b.cy")) ** 2)
    alike = F.abs(F.col("a.radius") - F.col("b.radius")) <= radius_part * F.greatest("a.radius", "b.radius")
    links = pairs.filter(alike & (off <= F.greatest("a.radius", "b.radius")) & (E.gap("z") <= gap_mm)).select(F.col("a.k").alias("a"), F.col("b.k").alias("b"))
    chain = own.join(components(links).withColumnRenamed("node", "k"), "k", "left").withColumn("chain", F.coalesce("root", "k"))
    return chain.groupBy("chain").agg(F.count("*").alias("parts"), F.min("min_z").alias("min_z"), F.max("max_z").alias("max_z"), F.bround(F.avg("radius"), 4).alias("radius"))


def junctions(walls: DataFrame, near_mm: float = 400.0) -> DataFrame:
    """Pairs of walls of different direction whose boxes come near: L where both end there, T where one runs on."""
    own = walls.filter("shape = 'plane_vertical'").withColumn("along_x", E.extent("x") >= E.extent("y"))
    pairs = spatial.box_pairs(own, own, near_mm).filter("a.along_x AND NOT b.along_x")
    inner = lambda side, other, axis: (F.col(f"{other}.c{axis}") > F.col(f"{side}.min_{axis}") + near_mm) & (F.col(f"{other}.c{axis}") < F.col(f"{side}.max_{axis}") - near_mm)
    return pairs.select(F.col("a.k").alias("a"), F.col("b.k").alias("b"), F.when(inner("a", "b", "x") | inner("b", "a", "y"), "T").otherwise("L").alias("kind"))


def hosted(details: DataFrame, hosts: DataFrame, slack_mm: float = 100.0) -> DataFrame:
    """The smallest host whose box, widened, holds each detail's centroid; ties to the smaller key."""
    pairs = spatial.box_pairs(details, hosts, slack_mm).filter("a.k <> b.k")
    for a in E.AXES:
        pairs = pairs.filter(F.col(f"a.c{a}").between(F.col(f"b.min_{a}") - slack_mm, F.col(f"b.max_{a}") + slack_mm))
    best = pairs.groupBy(F.col("a.k").alias("k")).agg(F.min(F.struct(E.volume("b").alias("v"), F.col("b.k").alias("host"))).alias("m"))
    return best.select("k", "m.host")


def nearest_storey(segments: DataFrame, heights: list[float]) -> DataFrame:
    """The storey height nearest to each segment's bottom, the lower of equals."""
    options = F.array(*(F.struct(F.abs(F.col("min_z") - h).alias("d"), F.lit(float(h)).alias("h")) for h in heights))
    return segments.select("k", F.array_min(options)["h"].alias("storey_mm"))


def enclosed(segments: DataFrame, reach_mm: float = 6000.0) -> DataFrame:
    """Segments with a wall on each of the four sides within reach on their storey or one next to it: the nearest of each side."""
    storey = F.bround(F.col("cz") / 3000.0)
    walls = segments.filter((F.col("shape") == "plane_vertical") & (F.greatest(E.extent("x"), E.extent("y")) >= 800)).withColumn("storey", storey)
    own = segments.filter("shape <> 'plane_vertical'").withColumn("storey", storey)
    pairs = spatial.box_pairs(own, walls, reach_mm, axes=("x", "y")).filter(F.abs(F.col("a.storey") - F.col("b.storey")) <= 1)
    beside = lambda axis: (F.col(f"a.c{axis}") >= F.col(f"b.min_{axis}") - 500) & (F.col(f"a.c{axis}") <= F.col(f"b.max_{axis}") + 500)
    side = E.case(
        [
            (beside("y") & (F.col("b.cx") < F.col("a.cx")) & (F.col("b.max_x") <= F.col("a.min_x")), F.lit("W")),
            (beside("y") & (F.col("b.min_x") >= F.col("a.max_x")), F.lit("E")),
            (beside("x") & (F.col("b.max_y") <= F.col("a.min_y")), F.lit("S")),
            (beside("x") & (F.col("b.min_y") >= F.col("a.max_y")), F.lit("N")),
        ],
        F.lit(None),
    )
    gap = F.greatest(E.gap("x"), E.gap("y"))
    best = pairs.withColumn("side", side).filter("side IS NOT NULL").groupBy(F.col("a.k").alias("k"), "side").agg(F.min(F.struct(gap.alias("g"), F.col("b.k").alias("w"))).alias("m"))
    wide = best.groupBy("k").agg(*[F.max(F.when(F.col("side") == s, F.col("m.w"))).alias(s.lower()) for s in "WESN"])
    return wide.filter("w IS NOT NULL AND e IS NOT NULL AND s IS NOT NULL AND n IS NOT NULL")
