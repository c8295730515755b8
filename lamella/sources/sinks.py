"""Writing volumes and nuclei."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_planes(voxels: DataFrame, path: str, keys: tuple[str, ...] = ("nucleus_id",)) -> bool:
    """Voxel rows as one row per plane of sorted (y, x, value) cells; nothing is written if there are none."""
    if voxels.isEmpty():
        return False
    value = next(c for c in voxels.columns if c not in (*keys, "z", "y", "x"))
    planes = voxels.groupBy(*keys, "z").agg(F.array_sort(F.collect_list(F.struct("y", "x", F.col(value).alias("value")))).alias("cells"))
    planes.write.mode("overwrite").parquet(path)
    return True


def load_planes(df: DataFrame, keys: tuple[str, ...] = ("nucleus_id",)) -> DataFrame:
    """Voxel rows of what ``save_planes`` wrote."""
    return df.select(*keys, "z", F.inline("cells"))
