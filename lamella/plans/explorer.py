"""The explorer's chain: reconstruct, clip, threshold, mesh or slice, chosen by dataset and mode."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions.constants import GAUSSIAN, LINEAR, NONE, SHOW_ALL, SIGMA, THICKNESS
from lamella.operators import geometry, mesh, reconstruct, slicing


@dataclass(frozen=True)
class View:
    """What a user sets: the plane, what it hides, and the mesh threshold."""

    azimuth: float = 0.0
    elevation: float = 90.0
    slice_offset: float = 0.0
    visibility: str = SHOW_ALL
    threshold: float = 0.05


def reconstruction(dataset: str, source: DataFrame, mode: str = NONE, sigma: float = SIGMA, thickness: float = THICKNESS, ai: DataFrame | None = None, sparse: bool = True) -> DataFrame:
    """Voxels of a dataset: of crops (key, y, x, p) extruded or by stored model output, of slices raw or filled."""
    if dataset == "CODEX":
        if mode in (GAUSSIAN, LINEAR, NONE):
            return reconstruct.extrude(source, mode, sigma, thickness, sparse)
        if ai is None:
            raise ValueError("stored volumes are needed for a model's reconstruction")
        return reconstruct.ai_or_zero(source.withColumnRenamed("crop_index", "nucleus_id"), ai)
    if dataset == "RESTORE":
        volume = reconstruct.normalise(source)
        return reconstruct.fill_gaps(volume) if mode == LINEAR else volume
    raise ValueError(f"unknown dataset {dataset}")


def plane_of(spark, view: View, centre: tuple[float, float, float]) -> DataFrame:
    cut = spark.createDataFrame([(0, float(view.azimuth), float(view.elevation), float(view.slice_offset))], "cut int, azimuth double, elevation double, slice_offset double")
    return geometry.plane_basis(cut, *centre)


def clipped(voxels: DataFrame, view: View, centre: tuple[float, float, float]) -> DataFrame:
    """The plane is four numbers, made by the same expressions as everywhere and put into the plan as literals."""
    normal = plane_of(voxels.sparkSession, view, centre).first()
    plane = {a: F.lit(normal[a]) for a in ("nx", "ny", "nz", "slice_offset")}
    return geometry.clip(voxels, plane, centre, view.visibility)


def mesh_view(voxels: DataFrame, view: View, key: str, centre: tuple[float, float, float]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices, faces and bounds of what the plane leaves."""
    left = clipped(voxels, view, centre)
    numbered = mesh.number_voxels(mesh.active_voxels(left, view.threshold), key)
    return mesh.mesh_vertices(numbered, key), mesh.mesh_faces(numbered, key), mesh.mesh_bounds(left, key, view.threshold)


def slice_view(voxels: DataFrame, view: View, key: str, centre: tuple[float, float, float], shape: tuple[int, int, int], size: int = 90) -> DataFrame:
    """The plane's cross-section, from the volume as it was before clipping."""
    points = slicing.sample_grid(plane_of(voxels.sparkSession, view, centre), shape, size)
    return slicing.oblique_slice(voxels, points, key)
