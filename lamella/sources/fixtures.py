"""Image-like tables derived from the test data, all by deterministic expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.session import table

RAW_CLASSES = ["adipocytes", "B cells", "plasma cells", "CD3+ T cells", "CD4+ T cells", "CD68+ macrophages", "NK cells", "unlisted cells", "tumor cells", "stroma"]
DIRTY = [(0, "1", "B cells"), (1, "x7", "nerves"), (2, "2", None), (3, " 3 ", "tumor cells"), (4, "1", "plasma cells"), (5, "4", "unlisted cells"), (6, None, "NK cells"), (7, "4", "CD8+ T cells")]
PATHS = ["a/one.ims", "a/one_mask.npy", "a/two.ims", "b/three.ims", "b/three_mask.npy", "b/c/four.ims.ims", "b/c/four.ims_mask.npy", "b/five_mask.npy"]
#: Plane cuts (cut, azimuth, elevation, offset), among them the default and both sides of the switch of the up vector.
CUTS = [(0, 37.0, 25.0, 1.5), (1, 0.0, 90.0, 0.0), (2, 45.0, 82.0, -3.0), (3, 120.0, 81.0, 2.5), (4, -60.0, -90.0, 0.0), (5, 180.0, 0.0, 10.0)]


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as an 8 by 8 image: (crop_index, y, x, p)."""
    e = F.abs(F.col("e").cast("double")) * 510
    cells = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("crop_index"), F.posexplode("embedding").alias("pos", "e"))
    return cells.select("crop_index", F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).cast("int").alias("x"), F.least(F.lit(255), F.floor(e)).cast("smallint").alias("p"))


def cell_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw class names by label; every eleventh crop has none."""
    names = F.array(*map(F.lit, RAW_CLASSES))
    return table(spark, sf_dir, "embeddings").where("vec_id % 11 <> 0").select(F.col("vec_id").alias("crop_index"), F.element_at(names, F.col("label") % 10 + 1).alias("raw_class"))


def dirty_metadata(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DIRTY, "ordinal int, crop_index string, classes string")


def file_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in PATHS], "path string")


def plane_cuts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CUTS, "cut int, azimuth double, elevation double, slice_offset double")


def nucleus_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five sparse slices to a nucleus: (nucleus_id, z, y, x, p)."""
    i = F.col("crop_index")
    z = (i % 5) * 13 + F.floor(i / 5) % 4 + 2
    return crops(spark, sf_dir).select(F.floor(i / 5).alias("nucleus_id"), z.cast("int").alias("z"), "y", "x", "p")


def label_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ellipsoid nucleus per supplier, sixteen to an image: (image, label, z, y, x, i)."""
    s = F.col("s")
    base = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("s"))
    base = base.select("s", F.floor(s / 16).cast("int").alias("image"), (s % 16).alias("t"), (s % 4).alias("rz"), (s % 5 + 3).alias("ry"), (s % 3 + 4).alias("rx"))
    base = base.withColumn("cy", F.floor(F.col("t") / 4).cast("int") * 40 + F.when(F.col("t") < 4, 6).otherwise(20)).withColumn("cx", F.col("t") % 4 * 40 + 20)
    for axis in ("z", "y", "x"):
        base = base.withColumn(f"d{axis}", F.explode(F.sequence(-F.col(f"r{axis}"), F.col(f"r{axis}"))))
    base = base.where("dy * dy * rx * rx + dx * dx * ry * ry <= rx * rx * ry * ry")
    out = base.select("image", (F.col("t") + 1).alias("label"), (F.col("dz") + 8).alias("z"), (F.col("cy") + F.col("dy")).alias("y"), (F.col("cx") + F.col("dx")).alias("x"), "s").where("y >= 0 and x >= 0")
    return out.select("image", "label", "z", "y", "x", (100 + (31 * F.col("x") + 17 * F.col("y") + 7 * F.col("z") + 13 * s) % 900).alias("i"))


def voxel_size(voxels: DataFrame) -> DataFrame:
    """(image, res_z, res_x) for the images of ``label_voxels``."""
    ratio = F.element_at(F.array(*map(F.lit, [0.25, 1.0, 2.0, 4.0])), F.col("image") % 4 + 1)
    return voxels.select("image").distinct().select("image", (F.lit(0.15) * ratio).alias("res_z"), F.lit(0.15).alias("res_x"))


#: Extent attributes that are odd: unknown, unreadable, empty, no voxels, and well known.
EXTENTS = [("unknown", False, "0", "9", "3", "0", "9", "3"), ("no text", True, None, None, None, None, None, None), ("words", True, "a", "4", "8", "x", "6", "2"), ("none", True, "0", "9", "0", "0", "9", "-1"), ("plain", True, "1.5", "4", "10", "-2", "2", "16")]


def extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extent attributes, as text, of the images of ``label_voxels`` (whose sizes ``voxel_size`` has) and of odd ones."""
    schema = "path string, known boolean, x_min string, x_max string, x_size string, z_min string, z_max string, z_size string"
    top = F.element_at(F.array(*map(F.lit, ["0.6", "2.4", "4.8", "9.6"])), F.col("image") % 4 + 1)
    own = label_voxels(spark, sf_dir).select("image").distinct()
    text = lambda v, name: F.lit(v).alias(name)
    own = own.select(F.col("image").cast("string").alias("path"), F.lit(True).alias("known"), text("0", "x_min"), text("9.6", "x_max"), text("64", "x_size"), text("0", "z_min"), top.alias("z_max"), text("16", "z_size"))
    return own.unionByName(spark.createDataFrame(EXTENTS, schema))


#: Image files as (path, depth, height, width, error): two are unreadable, one has a broken mask, one of another shape, one is whole.
IMAGES = [("a.ims", 4, 8, 8, None), ("b.ims", None, None, None, "truncated file"), ("c.ims", 4, 8, 8, None), ("d.ims", 4, 8, 8, None), ("e.ims", None, None, None, "no such channel")]
MASKS = [("a_mask.npy", 4, 8, 8, None), ("b_mask.npy", 4, 8, 8, None), ("c_mask.npy", None, None, None, "pickled"), ("d_mask.npy", 4, 8, 9, None), ("e_mask.npy", None, None, None, "empty")]


def image_files(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Planes of image files and of masks, without their pixels."""
    planes = lambda rows: spark.createDataFrame([(*r[:1], z, *r[1:]) for r in rows for z in range(r[1] or 1)], "path string, z int, depth int, height int, width int, error string")
    return planes(IMAGES), planes(MASKS)


def meshes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Model results: crops, and the meshes of some (crop_index, ordinal, success)."""
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("crop_index"))
    some = ids.where("crop_index % 5 <> 0").withColumn("ordinal", F.explode(F.sequence(F.col("crop_index") % 3, F.lit(3))))
    return ids, some.withColumn("success", (F.col("crop_index") + F.col("ordinal")) % 4 != 0)


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda n: F.col("embedding")[n].cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("mesh_id"), F.col("vec_id").alias("vertex_id"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), F.abs(at(3)).alias("intensity"))


def occupied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coarse set of occupied voxels for each mesh: (mesh_id, z, y, x)."""
    out = table(spark, sf_dir, "embeddings").select(F.col("label").alias("mesh_id")).distinct()
    for axis in ("z", "y", "x"):
        out = out.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(60), F.lit(4))))
    return out.where("(z + y + x + mesh_id) % 3 = 0")


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("nucleus_id"), F.posexplode("embedding").alias("pos", "e"))
    return e.select("nucleus_id", "pos", F.col("e").cast("double").alias("x"), F.when(F.floor(F.abs(F.col("e").cast("double")) * 510) > 25, 1.0).otherwise(0.0).alias("t"))
