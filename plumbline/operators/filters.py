"""Row filters and rewrites of segments and planes beside those of `segments`: usability, orientation, poses, transforms, conversion."""

from __future__ import annotations

import hashlib
import hmac
import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E

# Element types that are containers, and those that are runs of pipe.
CONTAINERS = ("tank", "pump", "hvac_equipment", "pressure_vessel", "heat_exchanger", "compressor", "pressurizer", "steam_generator", "emergency_diesel_generator", "transformer", "switchgear", "ups_system")
RUNS = ("pipe", "duct", "conduit", "cable_tray")
#: Largest error of a transform's rotation and of a point that goes there and back.
ROTATION_ERROR, ROUND_TRIP_M = 1e-6, 1e-6


def usability(segments: DataFrame) -> DataFrame:
    """Adds the first reason why a classified segment is of no use, null if it is usable. Doors and windows always are."""
    low, mid, high = E.sorted_extents()
    plane, rod, void = F.col("shape").startswith("plane_"), F.col("shape").isin("cylinder", "valve_candidate"), F.col("shape") == "void"
    arms = [
        (F.col("element_type").isin("door", "window"), F.lit(None)),
        (F.col("point_count") < 0, F.lit("negative point_count")),
        ((F.col("point_count") == 0) & ~void, F.lit("zero-point non-void segment")),
        (high.isNull(), F.lit("missing bounding_box")),
        (plane & (high < 200), F.lit("major planar span < 200mm")),
        (plane & (mid < 30), F.lit("mid planar span < 30mm")),
        (plane & (low < 0.5), F.lit("minor planar span < 0.5mm")),
        (rod & (high < 20), F.lit("major cylindrical span < 20mm")),
        (rod & (low < 0.7), F.lit("minor cylindrical span < 0.7mm")),
        (plane | rod, F.lit(None)),
        (high < 40, F.lit("major span < 40mm")),
        (~void & (mid < 20), F.lit("mid span < 20mm")),
        (~void & (low < 3), F.lit("minor span < 3mm")),
    ]
    return segments.withColumn("reason", E.case(arms, F.lit(None).cast("string")))


def implausible_tray() -> Column:
    """A cable tray that is low, wide and flat: more likely a surface."""
    flat = (E.extent("x") >= 300) & (E.extent("y") >= 1000) & (E.extent("z") <= 250)
    return (F.col("element_type") == "cable_tray") & (F.col("cz") <= 1000) & flat


def only_walls(segments: DataFrame, most: int | None = None, length_mm: float = 800.0, height_mm: float = 800.0) -> DataFrame:
    """Walls of a least length and height; with `most` the longest of them, ties to the smaller id."""
    long = F.greatest(E.extent("x"), E.extent("y"))
    walls = segments.filter((F.col("element_type") == "wall") & (long >= length_mm) & (E.extent("z") >= height_mm))
    return walls if most is None else walls.orderBy(long.desc(), "segment_id").limit(most)


def without_containers(segments: DataFrame) -> DataFrame:
    return segments.filter(~F.col("element_type").isin(*CONTAINERS))


def uniform_diameter(segments: DataFrame, diameter_mm: float) -> DataFrame:
    """Runs of pipe get this diameter around their centre; others keep their box and have none."""
    run = F.col("element_type").isin(*RUNS)
    box = {f"{side}_{a}": F.when(run, F.col(f"c{a}") + sign * diameter_mm / 2).otherwise(F.col(f"{side}_{a}")) for a in "xy" for side, sign in (("min", -1), ("max", 1))}
    return segments.withColumns(box | {"diameter_mm": F.when(run, F.lit(float(diameter_mm)))})


def upness(nx: Column, ny: Column, nz: Column, up: tuple[float, float, float] = (0.0, 0.0, 1.0)) -> Column:
    """How far a normal points along the up axis, 0 to 1, whichever way; a normal without length counts as up."""
    size = F.sqrt(nx * nx + ny * ny + nz * nz)
    u = np.asarray(up, float)
    u = u / np.linalg.norm(u) if np.linalg.norm(u) > 1e-9 else np.array([0.0, 0.0, 1.0])
    return F.when(size > 1e-9, F.abs(nx * float(u[0]) + ny * float(u[1]) + nz * float(u[2])) / size).otherwise(F.lit(abs(float(u[2]))))


def orientation(up: Column, vertical: float = 0.25, horizontal: float = 0.85) -> Column:
    return F.when(up < vertical, "plane_vertical").when(up >= horizontal, "plane_horizontal").otherwise("plane_sloped")


def split_vertical(planes: DataFrame, vertical: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """Planes (nx, ny, nz) that stand, as plane_vertical, and the others with what they are; those without a normal are among these."""
    up = upness(F.col("nx"), F.col("ny"), F.col("nz"))
    rows = planes.withColumn("up", F.when(F.col("nx").isNull() | F.col("ny").isNull() | F.col("nz").isNull(), F.lit(None)).otherwise(up))
    others = rows.filter("up IS NULL").withColumn("classification", F.lit(None).cast("string")).unionByName(rows.filter(F.col("up") >= vertical).withColumn("classification", F.when(F.col("up") >= 0.85, "FLOOR_SLAB").otherwise("SLOPED_SURFACE")))
    return rows.filter(F.col("up") < vertical).withColumn("shape", F.lit("plane_vertical")).drop("up"), others.drop("up")


class Transform:
    """A pose: turned, scaled and moved points, there and back. Rotation by row, scale above 0, translation in target units."""

    def __init__(self, rotation: list[list[float]], translation: list[float], scale: float = 1.0):
        self.rotation, self.translation, self.scale = np.asarray(rotation, float), np.asarray(translation, float), float(scale)

    def matrix(self) -> np.ndarray:
        m = np.eye(4)
        m[:3, :3], m[:3, 3] = self.rotation * self.scale, self.translation
        return m

    def inverse(self) -> np.ndarray:
        m = np.eye(4)
        m[:3, :3] = self.rotation.T / self.scale
        m[:3, 3] = -m[:3, :3] @ self.translation
        return m

    def apply(self, df: DataFrame, back: bool = False) -> DataFrame:
        """The rows with x, y, z moved, in Catalyst."""
        m = (self.inverse() if back else self.matrix()).tolist()
        return df.withColumns(dict(zip("xyz", E.affine(F.col("x"), F.col("y"), F.col("z"), m), strict=True)))

    def round_trip(self, df: DataFrame) -> DataFrame:
        """Largest and mean distance of points from where they come back to."""
        there = E.affine(F.col("x"), F.col("y"), F.col("z"), self.matrix().tolist())
        back = E.affine(*there, self.inverse().tolist())
        off = F.sqrt(sum((F.col(c) - b) ** 2 for c, b in zip("xyz", back, strict=True)))
        return df.agg(F.max(off).alias("max_error"), F.avg(off).alias("mean_error"))

    def faults(self) -> list[str]:
        """Why it is no pose: a rotation that isn't one, numbers that aren't finite, a scale that isn't above 0, points that don't come back."""
        found = []
        with np.errstate(all="ignore"):
            if not np.isfinite(self.matrix()).all():
                return ["not_finite"]
            if np.abs(self.rotation.T @ self.rotation - np.eye(3)).max() > ROTATION_ERROR:
                found.append("not_orthogonal")
            if abs(np.linalg.det(self.rotation) - 1) > ROTATION_ERROR:
                found.append("determinant")
            if self.scale <= 0:
                return [*found, "scale"]
            p = np.array([[1.0, 2.0, 3.0, 1.0], [-5.0, 10.0, -1.0, 1.0], [100.0, 200.0, 50.0, 1.0]]).T
            if np.linalg.norm((self.inverse() @ self.matrix() @ p - p)[:3], axis=0).max() > ROUND_TRIP_M:
                found.append("round_trip")
        return found

    def fingerprint(self, secret: str) -> str:
        """HMAC-SHA256 of the pose as canonical JSON."""
        text = json.dumps({"rotation": self.rotation.tolist(), "scale": self.scale, "translation": self.translation.tolist()}, sort_keys=True, separators=(",", ":"))
        return hmac.new(secret.encode(), text.encode(), hashlib.sha256).hexdigest()

    def stamped(self, segments: DataFrame, secret: str) -> DataFrame:
        """Adds pose_valid and pose_id to every row."""
        return segments.withColumns({"pose_valid": F.lit(not self.faults()), "pose_id": F.lit(self.fingerprint(secret))})


def to_model(raw: DataFrame, origin: tuple[float, float, float], zone: str) -> DataFrame:
    """Rows in metres (min_x .. max_z, sigma_m, thickness_m) as segments in millimetres about an origin, with thickness from 100 to
    600 mm, accuracy tier, zone and centre. Without a sigma it is 25 mm."""
    box = {f"{side}_{a}": F.bround((F.col(f"{side}_{a}") - o) * 1000, 4) for a, o in zip("xyz", origin, strict=True) for side in ("min", "max")}
    out = raw.withColumns(box).withColumns({f"c{a}": (F.col(f"min_{a}") + F.col(f"max_{a}")) / 2 for a in "xyz"})
    thick = F.when(F.col("thickness_m").isNotNull(), F.greatest(F.lit(100.0), F.least(F.lit(600.0), F.bround(F.col("thickness_m") * 1000, 4))))
    return out.withColumns({"thickness_mm": thick, "loa_tier": E.loa_tier(F.coalesce(F.col("sigma_m") * 1000, F.lit(25.0))), "zone_id": F.lit(zone)})
