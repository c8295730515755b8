"""Cutting planes: basis, clipping, outline, axis ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.functions.constants import HIDE_ABOVE, HIDE_BELOW
from lamella.functions.expr import col, f32


def plane_basis(cuts: DataFrame, cx: float | str, cy: float | str, cz: float | str) -> DataFrame:
    """Adds normal, origin and the two in-plane vectors of each cut; u and v are in x, y, z order.

    The up vector turns from z to y where the normal is within about eight
    degrees of the z axis, which the default elevation of 90 is.
    """
    theta, phi = F.radians("azimuth"), F.radians("elevation")
    out = cuts.withColumns({"nx": F.cos(phi) * F.cos(theta), "ny": F.cos(phi) * F.sin(theta), "nz": F.sin(phi)})
    wide = lambda c: col(c) if isinstance(c, str) else F.lit(float(c))
    out = out.withColumns({f"p{a}": wide(c) + F.col("slice_offset") * F.col(f"n{a}") for a, c in (("x", cx), ("y", cy), ("z", cz))})
    flat = F.abs(F.col("nz")) > 0.99
    raw = {"x": F.when(flat, F.col("nz")).otherwise(-F.col("ny")), "y": F.when(flat, F.lit(0.0)).otherwise(F.col("nx")), "z": F.when(flat, -F.col("nx")).otherwise(F.lit(0.0))}
    out = out.withColumns({f"r{a}": e for a, e in raw.items()})
    length = F.sqrt(F.col("rx") * F.col("rx") + F.col("ry") * F.col("ry") + F.col("rz") * F.col("rz")) + 1e-8
    out = out.withColumns({f"u{a}": F.col(f"r{a}") / length for a in "xyz"}).drop("rx", "ry", "rz")
    cross = lambda a, b: F.col(f"n{a}") * F.col(f"u{b}") - F.col(f"n{b}") * F.col(f"u{a}")
    return out.withColumns({"vx": cross("y", "z"), "vy": cross("z", "x"), "vz": cross("x", "y")})


def signed_distance(plane: dict[str, Column | float], cx: float, cy: float, cz: float) -> Column:
    """Distance of a voxel (x, y, z) from a plane given by normal and offset."""
    return (F.col("x") - cx) * plane["nx"] + (F.col("y") - cy) * plane["ny"] + (F.col("z") - cz) * plane["nz"] - plane["slice_offset"]


def clip(voxels: DataFrame, plane: dict[str, Column | float], centre: tuple[float, float, float], mode: str) -> DataFrame:
    """Zeroes the values on one side of a plane; voxels on the plane stay, and any other mode changes nothing."""
    if mode not in (HIDE_ABOVE, HIDE_BELOW):
        return voxels
    distance = signed_distance(plane, *centre)
    hidden = distance > 0 if mode == HIDE_ABOVE else distance < 0
    return voxels.withColumn("v", F.when(hidden, f32(0.0)).otherwise(F.col("v")))


def wireframe(planes: DataFrame, size: float = 40.0) -> DataFrame:
    """Five points (ordinal, x, y, z) round the square of each plane, the first one repeated."""
    h = size / 2
    signs = [(-h, -h), (h, -h), (h, h), (-h, h), (-h, -h)]
    point = lambda a, b: F.struct(*[(F.col(f"p{c}") + a * F.col(f"u{c}") + b * F.col(f"v{c}")).alias(c) for c in "xyz"])
    out = planes.select("cut", F.posexplode(F.array(*[point(a, b) for a, b in signs])).alias("ordinal", "point"))
    return out.select("cut", "ordinal", "point.x", "point.y", "point.z")


def axis_ticks(spark, scales: dict[str, float]) -> DataFrame:
    """Tick places and their labels in micrometres by dataset."""
    rows = spark.createDataFrame([(d, s) for d, s in scales.items()], "dataset string, scale double")
    at = F.explode(F.sequence(F.lit(0), F.lit(64), F.lit(16)))
    return rows.select("dataset", "scale", at.alias("tick")).select("dataset", "tick", F.format_string("%.1f", F.col("tick") * F.col("scale")).alias("label"))


def volume_centre(voxels: DataFrame, key: str) -> DataFrame:
    """Half the size of each volume along each axis: (key, cx, cy, cz); a volume ends at its last voxel."""
    return voxels.groupBy(key).agg(*[((F.max(a) + 1) / 2.0).alias(f"c{a}") for a in "xyz"])
