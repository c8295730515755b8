"""Oblique cross-sections of volumes, and block upscaling of images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.functions.expr import f32
from lamella.operators.reconstruct import depth_weight


def sample_grid(plane: DataFrame, shape: tuple[int, int, int], size: int = 90) -> DataFrame:
    """Points of a plane's grid inside a volume of shape (z, y, x): (cut, r, c, sx, sy, sz).

    At most size * size rows a cut, whatever the number of volumes. Points
    outside the volume, edges included in it, sample zero and aren't listed.
    """
    axis = lambda: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    grid = plane.withColumn("r", axis()).withColumn("c", axis())
    gx, gy = F.col("c") - size // 2, F.col("r") - size // 2
    point = {f"s{a}": F.col(f"p{a}") + gx * F.col(f"u{a}") + gy * F.col(f"v{a}") for a in "xyz"}
    out = grid.withColumns(point).select("cut", "r", "c", "sx", "sy", "sz")
    inside = [F.col(f"s{a}").between(0.0, float(n - 1)) for a, n in zip("zyx", shape)]
    return out.where(inside[0] & inside[1] & inside[2])


def _taps(axis: str) -> Column:
    """The two lattice neighbours along one axis, and their weights."""
    low = F.floor(F.col(f"s{axis}")).cast("int")
    part = F.col(f"s{axis}") - low
    tap = lambda at, w: F.struct(at.alias(axis), w.alias(f"w{axis}"))
    return F.inline(F.array(tap(low, 1.0 - part), tap(low + 1, part)))


def oblique_slice(voxels: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """Trilinear samples (cut, key, r, c, v) of any volume; pixels without a row are zero.

    The grid with its eight neighbours is a table of fixed size, so it is
    broadcast; voxels that no point touches drop out of the join.
    """
    taps = points
    for axis in "zyx":
        taps = taps.select("*", _taps(axis)).where(F.col(f"w{axis}") > 0)
    taps = taps.select("cut", "r", "c", "z", "y", "x", (F.col("wz") * F.col("wy") * F.col("wx")).alias("w"))
    hit = voxels.join(F.broadcast(taps), ["z", "y", "x"])
    out = hit.groupBy("cut", key, "r", "c").agg(F.sum(F.col("v").cast("double") * F.col("w")).alias("v"))
    return out.withColumn("v", f32(F.col("v")))


def oblique_slice_extruded(crops: DataFrame, points: DataFrame, key: str, method: str, **how) -> DataFrame:
    """The same for crops extruded over depth, without building the volume.

    A voxel is crop times depth weight and trilinear weights are a product, so
    a sample is the bilinear sample of the crop times the linear one of depth.
    """
    low = F.floor("sz").cast("int")
    part = F.col("sz") - low
    depth = points.withColumn("d", (1.0 - part) * depth_weight(low, method, **how) + part * depth_weight(low + 1, method, **how))
    for axis in "yx":
        depth = depth.select("*", _taps(axis)).where(F.col(f"w{axis}") > 0)
    taps = depth.select("cut", "r", "c", "y", "x", (F.col("wy") * F.col("wx") * F.col("d")).alias("w"))
    hit = crops.join(F.broadcast(taps), ["y", "x"])
    out = hit.groupBy("cut", key, "r", "c").agg(F.sum(F.col("p") / 255 * F.col("w")).alias("v"))
    return out.withColumn("v", f32(F.col("v")))


def upscale(image: DataFrame, factor: int, rows: str = "r", columns: str = "c") -> DataFrame:
    """Each pixel as a block of ``factor`` by ``factor``."""
    block = lambda: F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))
    out = image.withColumn("__i", block()).withColumn("__j", block())
    return out.withColumns({rows: F.col(rows) * factor + F.col("__i"), columns: F.col(columns) * factor + F.col("__j")}).drop("__i", "__j")
