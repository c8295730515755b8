"""All queries of the voxel engine by name, with the SQL they are checked against.

Where a result would be millions of voxels, a query sums each slice up; the
operators themselves return all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions.constants import GAUSSIAN, HIDE_ABOVE, HIDE_BELOW, LINEAR, MICRONS, NONE, TRAIN_THRESHOLD
from lamella.functions.expr import plain, unit
from lamella.operators import extract, geometry, labels, mesh, reconstruct, sampling, slicing
from lamella.plans import oracle
from lamella.plans.explorer import View, clipped
from lamella.session import bounded, cut, hashed
from lamella.sources import arrays, fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = oracle.SQL

CENTRE = (4.0, 4.0, 32.0)
SHAPE = (64, 8, 8)
TILT = View(azimuth=37.0, elevation=25.0, slice_offset=1.5)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def by_slice(voxels: DataFrame, key: str, value: str = "v") -> DataFrame:
    v = F.col(value).cast("double")
    return voxels.groupBy(key, "z").agg(F.count("*").alias("voxels"), plain(F.sum(v), 4).alias("total"), plain(F.max(v), 5).alias("peak"))


def _gaussian(spark, sf):
    return reconstruct.extrude(fixtures.crops(spark, sf), GAUSSIAN)


def _raw(spark, sf):
    return reconstruct.normalise(fixtures.nucleus_slices(spark, sf))


def _clipped(spark, sf, mode):
    view = View(TILT.azimuth, TILT.elevation, TILT.slice_offset, mode)
    return clipped(_gaussian(spark, sf), view, CENTRE)


@query
def flagship(spark, sf):
    """Gaussian volumes, clipped by an oblique plane, active voxels summed up by class label."""
    active = mesh.active_voxels(_clipped(spark, sf, HIDE_ABOVE))
    label = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("crop_index"), "label")
    v = F.col("v").cast("double")
    return active.join(label, "crop_index").groupBy("label").agg(F.count("*").alias("voxels"), plain(F.min(v)).alias("v_min"), plain(F.max(v)).alias("v_max"))


@query
def scan_crops(spark, sf):
    return fixtures.crops(spark, sf).select("crop_index", "y", "x", F.col("p").cast("int").alias("p"))


@query
def scan_nuclei(spark, sf):
    return fixtures.nucleus_slices(spark, sf).select("nucleus_id", "z", "y", "x", F.col("p").cast("int").alias("p"))


@query
def metadata_clean(spark, sf):
    return labels.consolidate(labels.clean_metadata(fixtures.dirty_metadata(spark)), "classes").select("crop_index", "cell_class")


@query
def voxel_size(spark, sf):
    sizes = extract.voxel_sizes(fixtures.extents(spark, sf))
    return sizes.select("path", plain(F.col("res_z")).alias("res_z"), plain(F.col("res_x")).alias("res_x"))


@query
def ingest_errors(spark, sf):
    images, masks = fixtures.image_files(spark)
    return arrays.ingest_errors(arrays.find_pairs(images.select("path").union(masks.select("path")).distinct()), images, masks)


@query
def first_mesh(spark, sf):
    """-1 where there is no mesh."""
    return sampling.first_mesh(*fixtures.meshes(spark, sf), "crop_index").withColumn("ordinal", F.coalesce("ordinal", F.lit(-1).cast("long")))


@query
def index_bounds(spark, sf):
    return sampling.index_bounds(fixtures.nucleus_slices(spark, sf), "nucleus_id")


@query
def volume_centre(spark, sf):
    return geometry.volume_centre(fixtures.label_voxels(spark, sf), "image")


@query
def file_pairs(spark, sf):
    return arrays.find_pairs(fixtures.file_list(spark))


@query
def nuclei_count(spark, sf):
    return fixtures.nucleus_slices(spark, sf).select("nucleus_id").distinct().agg(F.count("*").alias("nuclei"))


@query
def crop_lookup(spark, sf):
    return scan_crops(spark, sf).where("crop_index = 7")


@query
def normalize_u8(spark, sf):
    return fixtures.crops(spark, sf).select("crop_index", "y", "x", plain(unit("p")).alias("v"))


@query
def class_consolidate(spark, sf):
    return labels.consolidate(fixtures.cell_metadata(spark, sf), "raw_class").select("crop_index", "cell_class")


@query
def class_or_unknown(spark, sf):
    known = labels.consolidate(fixtures.cell_metadata(spark, sf), "raw_class").select("crop_index", "cell_class")
    return labels.class_or_unknown(fixtures.crops(spark, sf), known)


@query
def signal_slices(spark, sf):
    found = reconstruct.signal_slices(_raw(spark, sf))
    return found.select("nucleus_id", "z", plain(F.col("peak")).alias("peak"))


@query
def signal_slice_counts(spark, sf):
    return reconstruct.signal_slices(_raw(spark, sf), threshold=0.2).groupBy("nucleus_id").agg(F.count("*").alias("slices"))


@query
def active_voxels(spark, sf):
    """At 0.2, where a threshold in double precision would let one grey level more pass."""
    return by_slice(mesh.active_voxels(_raw(spark, sf), 0.2), "nucleus_id")


@query
def clip_above(spark, sf):
    return by_slice(_clipped(spark, sf, HIDE_ABOVE), "crop_index")


@query
def clip_below(spark, sf):
    return by_slice(_clipped(spark, sf, HIDE_BELOW), "crop_index")


@query
def recon_gaussian(spark, sf):
    return by_slice(_gaussian(spark, sf), "crop_index")


@query
def recon_linear(spark, sf):
    return by_slice(reconstruct.extrude(fixtures.crops(spark, sf), LINEAR), "crop_index")


@query
def recon_none(spark, sf):
    return by_slice(reconstruct.extrude(fixtures.crops(spark, sf), NONE, sparse=True), "crop_index")


@query
def restore_raw(spark, sf):
    return by_slice(_raw(spark, sf), "nucleus_id")


@query
def gap_fill(spark, sf):
    return by_slice(reconstruct.fill_gaps(_raw(spark, sf)), "nucleus_id")


@query
def gap_fill_train(spark, sf):
    return by_slice(reconstruct.fill_gaps(_raw(spark, sf), threshold=TRAIN_THRESHOLD), "nucleus_id")


@query
def ai_or_zero(spark, sf):
    """Stored volumes for the even crops, 16 deep, zeros for the others."""
    crops = fixtures.crops(spark, sf).withColumnRenamed("crop_index", "nucleus_id")
    stored = crops.where("nucleus_id % 2 = 0").select("nucleus_id", F.lit(5).alias("z"), "y", "x", unit("p").alias("v"))
    return by_slice(reconstruct.ai_or_zero(crops, stored, size=8), "nucleus_id")


@query
def plane_basis(spark, sf):
    planes = geometry.plane_basis(fixtures.plane_cuts(spark), 32.0, 32.0, 32.0)
    return planes.select("cut", *[plain(F.col(f"{k}{a}"), 9).alias(f"{k}{a}") for k in "npuv" for a in "xyz"])


@query
def plane_wireframe(spark, sf):
    points = geometry.wireframe(geometry.plane_basis(fixtures.plane_cuts(spark), 32.0, 32.0, 32.0))
    return points.select("cut", "ordinal", *[plain(F.col(a)).alias(a) for a in "xyz"])


@query
def axis_ticks(spark, sf):
    return geometry.axis_ticks(spark, MICRONS)


def _numbered(spark, sf):
    return mesh.number_voxels(mesh.active_voxels(_clipped(spark, sf, HIDE_ABOVE)), "crop_index")


@query
def mesh_vertices(spark, sf):
    v = mesh.mesh_vertices(_numbered(spark, sf), "crop_index")
    sums = [plain(F.sum(F.col(f"v{a}") * (F.col("vertex_no") % 97)), 3).alias(f"sum_{a}") for a in "xyz"]
    return v.groupBy("crop_index").agg(F.count("*").alias("vertices"), F.max("vertex_no").alias("last"), *sums, plain(F.sum(F.col("vc").cast("double")), 3).alias("sum_c"))


@query
def mesh_faces(spark, sf):
    f = mesh.mesh_faces(_numbered(spark, sf), "crop_index")
    sums = [F.sum(F.col(f"v{a}") * (F.col("face_no") % 89)).alias(f"sum_{a}") for a in "ijk"]
    return f.groupBy("crop_index").agg(F.count("*").alias("faces"), F.max("face_no").alias("last"), *sums)


@query
def mesh_bounds(spark, sf):
    out = mesh.mesh_bounds(_clipped(spark, sf, HIDE_ABOVE), "crop_index", 0.2)
    return out.select("crop_index", plain(F.col("v_min"), 5).alias("v_min"), plain(F.col("v_max"), 5).alias("v_max"), "active")


def _points(spark):
    planes = geometry.plane_basis(fixtures.plane_cuts(spark), *CENTRE)
    return slicing.sample_grid(planes, SHAPE)


def _image_sums(image: DataFrame, key: str) -> DataFrame:
    v = F.col("v").cast("double")
    return image.groupBy("cut", key).agg(F.count_if(v != 0).alias("lit"), plain(F.sum(v), 4).alias("total"), plain(F.sum(v * (F.col("r") % 7 + 1) * (F.col("c") % 5 + 1)), 3).alias("mixed"))


@query
def oblique_slice(spark, sf):
    """Gap-filled volumes cut by all planes."""
    return _image_sums(slicing.oblique_slice(reconstruct.fill_gaps(_raw(spark, sf)), _points(spark), "nucleus_id"), "nucleus_id")


@query
def oblique_slice_extruded(spark, sf):
    return _image_sums(slicing.oblique_slice_extruded(fixtures.crops(spark, sf), _points(spark), "crop_index", GAUSSIAN), "crop_index")


@query
def upscale_8x(spark, sf):
    image = slicing.oblique_slice(_raw(spark, sf), _points(spark), "nucleus_id")
    return _image_sums(slicing.upscale(image, 8), "nucleus_id")


@query
def upscale_4x(spark, sf):
    big = slicing.upscale(fixtures.crops(spark, sf), 4, "y", "x")
    return big.groupBy("crop_index").agg(F.count("*").alias("pixels"), F.sum("p").alias("total"), F.sum(F.col("p") * (F.col("y") * 3 + F.col("x"))).alias("mixed"))


@query
def slice_montage(spark, sf):
    """Signal slices side by side in the order of depth, twice as large."""
    from pyspark.sql import Window

    signal = reconstruct.signal_slices(_raw(spark, sf), threshold=0.2)
    place = signal.select("nucleus_id", "z", (F.row_number().over(Window.partitionBy("nucleus_id").orderBy("z")) - 1).alias("place"))
    wide = fixtures.nucleus_slices(spark, sf).join(place, ["nucleus_id", "z"]).withColumn("x", F.col("x") + 8 * F.col("place"))
    big = slicing.upscale(wide, 2, "y", "x")
    return big.groupBy("nucleus_id").agg(F.count("*").alias("pixels"), (F.max("x") + 1).alias("width"), F.sum(F.col("p") * (F.col("y") * 3 + F.col("x"))).alias("mixed"))


def _windows(spark, sf):
    return extract.crop_windows(extract.bounding_boxes(fixtures.label_voxels(spark, sf)))


def _isolated(spark, sf):
    return extract.isolate(fixtures.label_voxels(spark, sf), _windows(spark, sf))


@query
def nucleus_bbox(spark, sf):
    return extract.bounding_boxes(fixtures.label_voxels(spark, sf))


@query
def crop_window(spark, sf):
    return _windows(spark, sf).select("image", "label", "s_new", "y_start", "x_start")


@query
def label_isolate(spark, sf):
    return _isolated(spark, sf).select("image", "label", "d", "ly", "lx", "i")


@query
def nucleus_percentiles(spark, sf):
    p = extract.percentiles(_isolated(spark, sf))
    return p.select("image", "label", plain(F.col("lo")).alias("lo"), plain(F.col("hi")).alias("hi"))


def _stretched(spark, sf):
    own = _isolated(spark, sf)
    return extract.stretch(own, extract.percentiles(own))


@query
def nucleus_normalize(spark, sf):
    return _stretched(spark, sf).select("image", "label", "d", "ly", "lx", plain(F.col("v"), 5).alias("v"))


def _placed(spark, sf):
    return extract.place_depth(_stretched(spark, sf), fixtures.voxel_size(fixtures.label_voxels(spark, sf)))


@query
def z_place(spark, sf):
    return _placed(spark, sf).select("image", "label", "d", "z").distinct()


@query
def xy_zoom(spark, sf):
    v = extract.zoom(_placed(spark, sf), bounded(cut(extract.zoom_taps(_windows(spark, sf)))))
    s = F.col("v").cast("double")
    return v.groupBy("image", "label", "d").agg(F.count_if(s > 1e-6).alias("lit"), plain(F.sum(s), 3).alias("total"), plain(F.sum(s * (F.col("y") + 2 * F.col("x"))), 1).alias("mixed"))


@query
def quantize_u8(spark, sf):
    """The whole extraction, by depth."""
    sizes = fixtures.voxel_size(fixtures.label_voxels(spark, sf))
    v = extract.nuclei(fixtures.label_voxels(spark, sf), sizes)
    return v.groupBy("image", "label", "z").agg(F.count("*").alias("voxels"), F.sum(F.col("p").cast("long")).alias("total"))


@query
def nucleus_ids(spark, sf):
    return extract.number_nuclei(extract.percentiles(_isolated(spark, sf)).select("image", "label"))


@query
def nuclei_per_image(spark, sf):
    return extract.nuclei_per_image(extract.percentiles(_isolated(spark, sf)).select("image", "label"))


@query
def contrast_stretch(spark, sf):
    return sampling.contrast_stretch(fixtures.crops(spark, sf)).withColumn("p", F.col("p").cast("int"))


@query
def foreground_mask(spark, sf):
    return sampling.foreground_mask(fixtures.crops(spark, sf))


@query
def center_paste(spark, sf):
    """Nuclei in their own box, pasted into cubes of 12, which most are wider than."""
    boxes = extract.bounding_boxes(fixtures.label_voxels(spark, sf))
    own = fixtures.label_voxels(spark, sf).join(hashed(boxes), ["image", "label"])
    own = own.select("image", "label", *[(F.col(a) - F.col(f"{a}0")).alias(a) for a in "zyx"], "i")
    sizes = boxes.select("image", "label", *[(F.col(f"{a}1") - F.col(f"{a}0")).alias(f"s{a}") for a in "zyx"])
    return sampling.center_paste(own, sizes, ["image", "label"], 12).select("image", "label", "z", "y", "x", "i")


@query
def nn_transfer(spark, sf):
    out = sampling.nearest_vertex(fixtures.occupied(spark, sf), fixtures.vertices(spark, sf))
    return out.select("mesh_id", "z", "y", "x", "vertex_id", plain(F.col("intensity")).alias("intensity"))


@query
def gaussian_blur3d(spark, sf):
    return by_slice(sampling.gaussian_blur(_raw(spark, sf), "nucleus_id", SHAPE), "nucleus_id")


def _train(spark, sf):
    return sampling.train_images(reconstruct.fill_gaps(_raw(spark, sf), threshold=TRAIN_THRESHOLD))


@query
def best_slice(spark, sf):
    return sampling.best_slice(reconstruct.fill_gaps(_raw(spark, sf), threshold=TRAIN_THRESHOLD))


@query
def train_mask(spark, sf):
    image = _train(spark, sf).select("nucleus_id", F.col("y").alias("r"), F.col("x").alias("c"), "mask", F.col("level").cast("int").alias("level"))
    return sampling.never_empty(image, "nucleus_id", "mask", 4)


@query
def resize_nearest(spark, sf):
    out = sampling.resize_nearest(_train(spark, sf), "nucleus_id", "mask", 8, 65)
    return out.groupBy("nucleus_id").agg(F.count("*").alias("pixels"), F.sum(F.col("mask") * (F.col("r") + 2 * F.col("c"))).alias("mixed"))


@query
def resize_bicubic(spark, sf):
    image = _train(spark, sf).withColumn("level", F.col("level").cast("int"))
    out = sampling.resize_bicubic(image, "nucleus_id", "level", 8, 65)
    return out.groupBy("nucleus_id").agg(F.count("*").alias("pixels"), F.sum(F.col("level") * (F.col("r") + 2 * F.col("c"))).alias("mixed"))


@query
def pointmap(spark, sf):
    out = sampling.pointmap(spark, 33, 65)
    return out.select("r", "c", *[plain(F.col(k)).alias(k) for k in ("px", "py", "pz")])


@query
def bce_loss(spark, sf):
    return sampling.bce_loss(fixtures.logits(spark, sf), "nucleus_id").select("nucleus_id", plain(F.col("loss")).alias("loss"))


@query
def epoch_loss(spark, sf):
    """Mean of the batches' means, sixteen nuclei to a batch."""
    batch = fixtures.logits(spark, sf).withColumn("batch", F.floor(F.col("nucleus_id") / 16))
    return sampling.bce_loss(batch, "batch").agg(plain(F.avg("loss")).alias("loss"))


@query
def sample_collate(spark, sf):
    rows = fixtures.logits(spark, sf).groupBy("nucleus_id").agg(F.max("x").alias("top"))
    own = rows.select("nucleus_id", F.when(F.col("top") > 0.2, plain(F.col("top"))).alias("scale"), F.lit(None).cast("double").alias("shift"))
    return sampling.collate(own)


@query
def shuffle_batches(spark, sf):
    return sampling.batches(fixtures.nucleus_slices(spark, sf).select("nucleus_id").distinct(), "nucleus_id", 16, seed=1)


@query
def random_nucleus(spark, sf):
    return sampling.pick_random(fixtures.nucleus_slices(spark, sf).select("nucleus_id").distinct(), "nucleus_id", seed=1)
