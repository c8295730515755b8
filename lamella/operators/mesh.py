"""Block meshes of active voxels: vertices, faces, bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions.constants import CORNERS, FACES, MESH_THRESHOLD
from lamella.functions.expr import f32


def active_voxels(voxels: DataFrame, threshold: float = MESH_THRESHOLD) -> DataFrame:
    """Voxels above the threshold, compared in single precision."""
    return voxels.where(F.col("v") > f32(threshold))


def number_voxels(active: DataFrame, key: str) -> DataFrame:
    """Adds voxel_no, from 0 within a volume in the order of z, y, x."""
    order = Window.partitionBy(key).orderBy("z", "y", "x")
    return active.withColumn("voxel_no", F.row_number().over(order).cast("long") - 1)


def mesh_vertices(numbered: DataFrame, key: str) -> DataFrame:
    """Eight corners a voxel: (key, vertex_no, vx, vy, vz, vc)."""
    corner = lambda n, d: F.struct(F.lit(n).alias("n"), *[(F.col(a) + d[i]).alias(f"v{a}") for i, a in enumerate("xyz")])
    out = numbered.select(key, "voxel_no", F.col("v").alias("vc"), F.inline(F.array(*[corner(n, d) for n, d in enumerate(CORNERS)])))
    return out.select(key, (F.col("voxel_no") * 8 + F.col("n")).alias("vertex_no"), "vx", "vy", "vz", "vc")


def mesh_faces(numbered: DataFrame, key: str) -> DataFrame:
    """Twelve triangles a voxel: (key, face_no, vi, vj, vk); faces between voxels aren't left out."""
    at: Column = F.col("voxel_no") * 8
    face = lambda n, f: F.struct(F.lit(n).alias("n"), *[(at + c).alias(f"v{a}") for c, a in zip(f, "ijk")])
    out = numbered.select(key, "voxel_no", F.inline(F.array(*[face(n, f) for n, f in enumerate(FACES)])))
    return out.select(key, (F.col("voxel_no") * 12 + F.col("n")).alias("face_no"), "vi", "vj", "vk")


def mesh_bounds(voxels: DataFrame, key: str, threshold: float = MESH_THRESHOLD) -> DataFrame:
    """Least and largest active value of each volume; 0 and 1 where none is active."""
    active = F.when(F.col("v") > f32(threshold), F.col("v").cast("double"))
    return voxels.groupBy(key).agg(F.coalesce(F.min(active), F.lit(0.0)).alias("v_min"), F.coalesce(F.max(active), F.lit(1.0)).alias("v_max"), F.count(active).alias("active"))
