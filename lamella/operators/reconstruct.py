"""Volumes from single crops and from sparse slices, as voxel rows (id, z, y, x, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions.constants import CENTRE_Z, DEPTH, GAUSSIAN, LINEAR, NONE, SIGMA, THICKNESS, VIEW_THRESHOLD
from lamella.functions.expr import f32, unit


def depth_weight(z: Column, method: str, sigma: float = SIGMA, thickness: float = THICKNESS) -> Column:
    """A slice's weight by its distance from the centre; an unknown method weighs nothing."""
    away = F.abs(z - CENTRE_Z)
    half = thickness / 2.0
    if method == GAUSSIAN:
        return F.exp(-(away * away) / (2.0 * sigma * sigma))
    if method == LINEAR:
        return F.when(away < half, 1.0 - away / half).otherwise(0.0)
    if method == NONE:
        return F.when(z == CENTRE_Z, 1.0).otherwise(0.0)
    return F.lit(0.0)


def extrude(crops: DataFrame, method: str = GAUSSIAN, sigma: float = SIGMA, thickness: float = THICKNESS, sparse: bool = False) -> DataFrame:
    """A crop over all depths, weighted. ``sparse`` leaves out slices without weight, which hold zeros alone."""
    depths = F.explode(F.sequence(F.lit(0), F.lit(DEPTH - 1)))
    out = crops.withColumn("v", unit("p")).withColumn("z", depths)
    weight = depth_weight(F.col("z"), method, sigma, thickness)
    if sparse:
        out = out.where(weight > 0)
    keys = [c for c in crops.columns if c not in ("y", "x", "p")]
    return out.select(*keys, "z", "y", "x", f32(F.col("v") * weight).alias("v"))


def normalise(slices: DataFrame) -> DataFrame:
    """Grey levels as values from 0 to 1."""
    return slices.withColumn("v", unit("p")).drop("p")


def signal_slices(voxels: DataFrame, key: str = "nucleus_id", threshold: float = VIEW_THRESHOLD) -> DataFrame:
    """Slices (key, z, peak) whose largest value exceeds the threshold."""
    return voxels.groupBy(key, "z").agg(F.max("v").alias("peak")).where(F.col("peak") > f32(threshold))


def fill_gaps(voxels: DataFrame, key: str = "nucleus_id", threshold: float = VIEW_THRESHOLD) -> DataFrame:
    """Slices between consecutive signal slices become their linear mix; all others stay as they are.

    Signal slices are few, so the gaps between them are found on their table
    alone; each signal voxel then gives its share to the slices of the gap on
    either side, and shares add up. No voxel column is ordered or windowed.
    """
    signal = signal_slices(voxels, key, threshold)
    order = Window.partitionBy(key).orderBy("z")
    both = signal.select(key, "z", F.lag("z").over(order).alias("below"), F.lead("z").over(order).alias("above"))
    # Slices to which a signal slice gives a share, and how much of itself.
    shares = _shares(both, key, "above").unionByName(_shares(both, key, "below"))
    source = voxels.withColumnRenamed("z", "from_z")
    filled = source.join(shares, [key, "from_z"]).groupBy(key, "z", "y", "x").agg(F.sum(F.col("share") * F.col("v").cast("double")).alias("v"))
    kept = voxels.join(shares.select(key, "z").distinct(), [key, "z"], "left_anti")
    return kept.select(key, "z", "y", "x", "v").unionByName(filled.select(key, "z", "y", "x", f32(F.col("v")).alias("v")))


def _shares(both: DataFrame, key: str, side: str) -> DataFrame:
    """(key, from_z, z, share) for the slices between a signal slice and its neighbour on one side."""
    if side == "above":
        rows = both.where("above > z + 1").select(key, F.col("z").alias("from_z"), "above", F.explode(F.sequence(F.col("z") + 1, F.col("above") - 1)).alias("at"))
        share = 1.0 - (F.col("at") - F.col("from_z")) / (F.col("above") - F.col("from_z"))
    else:
        rows = both.where("below < z - 1").select(key, F.col("z").alias("from_z"), "below", F.explode(F.sequence(F.col("below") + 1, F.col("z") - 1)).alias("at"))
        share = (F.col("at") - F.col("below")) / (F.col("from_z") - F.col("below"))
    return rows.select(key, "from_z", F.col("at").alias("z"), share.alias("share"))


def ai_or_zero(wanted: DataFrame, ai_volumes: DataFrame, key: str = "nucleus_id", size: int = DEPTH) -> DataFrame:
    """Stored volumes of the nuclei asked for, and zeros where there are none."""
    here = wanted.select(key).distinct()
    axis = lambda: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    grid = here.withColumn("z", axis()).withColumn("y", axis()).withColumn("x", axis())
    return grid.join(ai_volumes, [key, "z", "y", "x"], "left").select(key, "z", "y", "x", F.coalesce("v", f32(0.0)).alias("v"))
