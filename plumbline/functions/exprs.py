"""Column expressions over boxes (min_x .. max_z, in millimetres), axes and tiers. All stay inside Catalyst."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")

# Accuracy tiers (largest 2 sigma in mm), registration classes (largest error in mm, least inlier ratio).
LOA = (("LOA50", 0.1), ("LOA40", 1.0), ("LOA30", 5.0), ("LOA20", 15.0), ("LOA10", 50.0))
RICS = (("A", 3.0, 0.90), ("B", 10.0, 0.80), ("C", 50.0, 0.60))


def col(name: str, side: str = "") -> Column:
    return F.col(f"{side}.{name}" if side else name)


def extent(axis: str, side: str = "") -> Column:
    return col(f"max_{axis}", side) - col(f"min_{axis}", side)


def sorted_extents(side: str = "") -> tuple[Column, Column, Column]:
    """Smallest, middle and largest extent."""
    e = [extent(a, side) for a in AXES]
    low, high = F.least(*e), F.greatest(*e)
    return low, e[0] + e[1] + e[2] - low - high, high


def volume(side: str = "") -> Column:
    return reduce(lambda a, b: a * b, (extent(a, side) for a in AXES))


def gap(axis: str, a: str = "a", b: str = "b") -> Column:
    """Distance of two boxes along an axis; negative where they overlap."""
    return F.greatest(col(f"min_{axis}", a), col(f"min_{axis}", b)) - F.least(col(f"max_{axis}", a), col(f"max_{axis}", b))


def intersection(a: str = "a", b: str = "b") -> Column:
    return reduce(lambda x, y: x * y, (F.greatest(-gap(axis, a, b), F.lit(0.0)) for axis in AXES))


def iou(a: str = "a", b: str = "b") -> Column:
    """Shared volume over united volume; 0 if both are flat."""
    both = intersection(a, b)
    return F.coalesce(F.try_divide(both, volume(a) + volume(b) - both), F.lit(0.0))


def containment(a: str = "a", b: str = "b") -> Column:
    """Shared volume over that of the smaller box; 0 if it is flat."""
    return F.coalesce(F.try_divide(intersection(a, b), F.least(volume(a), volume(b))), F.lit(0.0))


def box_distance(a: str = "a", b: str = "b") -> Column:
    return F.sqrt(reduce(lambda x, y: x + y, (F.pow(F.greatest(gap(axis, a, b), F.lit(0.0)), 2) for axis in AXES)))


def round_even(c: Column, digits: int) -> Column:
    """A double rounded as DuckDB's round_even does: the product by a power of ten is rounded, halves to even. Spark's bround looks
    at the shortest decimal that stands for the double, and calls fewer of them halves."""
    return F.rint(c * float(10**digits)) / float(10**digits)


def case(arms: list[tuple[Column, Column]], other: Column) -> Column:
    """The first arm whose condition holds."""
    whole = None
    for condition, value in arms:
        whole = F.when(condition, value) if whole is None else whole.when(condition, value)
    return whole.otherwise(other)


def case_sql(rules: list[tuple[str, str]], other: str) -> str:
    """A CASE over rules kept as data, (condition, value) in order; the first that holds counts."""
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in rules) + f" ELSE '{other}' END"


def loa_tier(sigma_mm: Column) -> Column:
    """Tier of twice the deviation; a negative one is an error."""
    tier = case([(2 * sigma_mm <= most, F.lit(name)) for name, most in LOA], F.lit("LOA10"))
    return F.when(sigma_mm < 0, F.raise_error(F.lit("negative deviation"))).otherwise(tier)


def loa_rank(tier: Column) -> Column:
    """0 for the tightest tier, larger for looser ones."""
    return case([(tier == name, F.lit(i)) for i, (name, _) in enumerate(LOA)], F.lit(len(LOA) - 1))


def rics_class(rmse_mm: Column, inlier_ratio: Column) -> Column:
    return case([((rmse_mm <= most) & (inlier_ratio >= least), F.lit(name)) for name, most, least in RICS], F.lit("FAIL"))


def canonical_axis(ax: Column, ay: Column) -> tuple[Column, Column]:
    """The direction or its opposite, so that opposite axes are equal."""
    turn = (ax < -1e-6) | ((F.abs(ax) <= 1e-6) & (ay < 0))
    return F.when(turn, -ax).otherwise(ax), F.when(turn, -ay).otherwise(ay)


def axis_angle(ax: Column, ay: Column) -> Column:
    """Degrees in [0, 180), four places."""
    x, y = canonical_axis(ax, ay)
    return F.bround(F.pmod(F.degrees(F.atan2(y, x)), F.lit(180.0)), 4)


def affine(x: Column, y: Column, z: Column, matrix: list[list[float]]) -> tuple[Column, ...]:
    """A 3x4 or 4x4 transform of a point, by row."""
    return tuple(x * r[0] + y * r[1] + z * r[2] + r[3] for r in matrix[:3])
