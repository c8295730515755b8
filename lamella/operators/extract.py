"""Nuclei out of labelled images, as sparse voxel rows (image, label, z, y, x, i)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions.constants import DEPTH, MIN_DEPTH, MIN_SPATIAL
from lamella.functions.expr import clamp, f32, half_even, to_grey
from lamella.session import bounded, cut, hashed

KEYS = ["image", "label"]


def voxel_sizes(extents: DataFrame) -> DataFrame:
    """(path, res_z, res_x) from extent attributes as text; what can't be read has its default, and an unknown image 1."""
    number = lambda c, default: F.coalesce(F.expr(f"try_cast({c} as double)"), F.lit(default))

    def size(axis: str) -> Column:
        n = number(f"{axis}_size", 1.0)
        return F.when(F.col("known") & (n > 0), (number(f"{axis}_max", 1.0) - number(f"{axis}_min", 0.0)) / n).otherwise(1.0)

    return extents.select("path", size("z").alias("res_z"), size("x").alias("res_x"))


def bounding_boxes(voxels: DataFrame, min_depth: int = MIN_DEPTH, min_spatial: int = MIN_SPATIAL) -> DataFrame:
    """Half-open box of each label that is deep, high and wide enough; label 0 is background."""
    ends = [e for a in "zyx" for e in (F.min(a).alias(f"{a}0"), (F.max(a) + 1).alias(f"{a}1"))]
    boxes = voxels.where("label > 0").groupBy(*KEYS).agg(*ends)
    return boxes.where((F.col("z1") - F.col("z0") >= min_depth) & (F.col("y1") - F.col("y0") >= min_spatial) & (F.col("x1") - F.col("x0") >= min_spatial))


def crop_windows(boxes: DataFrame) -> DataFrame:
    """Adds the square window of twice the box's size (s_new) and its start; halves round to even."""
    out = boxes.withColumn("s_new", 2 * F.greatest(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")))
    start = lambda a: half_even((F.col(f"{a}0") + F.col(f"{a}1")) / 2.0 - F.col("s_new") / 2.0)
    return out.withColumn("y_start", start("y")).withColumn("x_start", start("x"))


def isolate(voxels: DataFrame, windows: DataFrame) -> DataFrame:
    """A nucleus' own voxels in its window (d, ly, lx, i); all other places of the window are zero and have no row."""
    out = voxels.join(hashed(windows.select(*KEYS, "z0", "z1", "s_new", "y_start", "x_start")), KEYS)
    local = {"d": F.col("z") - F.col("z0"), "ly": F.col("y") - F.col("y_start"), "lx": F.col("x") - F.col("x_start")}
    return out.withColumns(local).select(*KEYS, "s_new", (F.col("z1") - F.col("z0")).alias("depth"), "d", "ly", "lx", "i")


def percentiles(isolated: DataFrame) -> DataFrame:
    """Exact first and last percentile of a nucleus' own pixels; those without contrast are left out."""
    both = isolated.groupBy(*KEYS).agg(F.percentile("i", F.array(F.lit(0.01), F.lit(0.99))).alias("p"))
    return both.select(*KEYS, F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi")).where("hi > lo")


def stretch(isolated: DataFrame, bounds: DataFrame) -> DataFrame:
    """Values between the percentiles as 0 to 1."""
    out = isolated.join(hashed(bounds), KEYS)
    return out.withColumn("v", f32(clamp((F.col("i") - F.col("lo")) / (F.col("hi") - F.col("lo")), 0.0, 1.0))).drop("lo", "hi", "i")


def place_depth(isolated: DataFrame, sizes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Adds z, the slice's place in the cube by physical depth; slices that fall outside are dropped."""
    out = isolated.join(sizes, "image")
    pixel = F.col("s_new") * F.col("res_x") / float(depth)
    step = F.when(pixel > 0, F.col("res_z") / pixel).otherwise(0.0)
    z = half_even((depth - 1) / 2.0 + (F.col("d") - (F.col("depth") - 1) / 2.0) * step)
    return out.withColumn("z", z).where(F.col("z").between(0, depth - 1)).drop("res_z", "res_x")


def zoom_taps(windows: DataFrame, size: int = DEPTH) -> DataFrame:
    """For each window size: output j takes input k with weight w; corners are aligned."""
    out = windows.select("s_new").distinct().withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    at = F.col("j") * (F.col("s_new") - 1) / float(size - 1)
    out = out.withColumn("at", at).withColumn("low", F.floor("at").cast("int"))
    part = F.col("at") - F.col("low")
    pair = F.array(F.struct(F.col("low").alias("k"), (1.0 - part).alias("w")), F.struct((F.col("low") + 1).alias("k"), part.alias("w")))
    return out.select("s_new", "j", F.inline(pair)).where("w > 0")


def zoom(placed: DataFrame, taps: DataFrame) -> DataFrame:
    """Each slice resized to the cube's face, by rows and then by columns; still apart by source slice d."""
    rows = placed.join(taps.select("s_new", F.col("j").alias("y"), F.col("k").alias("ly"), F.col("w").alias("wy")), ["s_new", "ly"])
    rows = rows.groupBy(*KEYS, "s_new", "d", "z", "y", "lx").agg(F.sum(F.col("v").cast("double") * F.col("wy")).alias("v"))
    both = rows.join(taps.select("s_new", F.col("j").alias("x"), F.col("k").alias("lx"), F.col("w").alias("wx")), ["s_new", "lx"])
    out = both.groupBy(*KEYS, "d", "z", "y", "x").agg(F.sum(F.col("v") * F.col("wx")).alias("v"))
    return out.withColumn("v", f32(F.col("v")))


def merge_depth(zoomed: DataFrame) -> DataFrame:
    """Slices that fall on the same depth keep the larger value."""
    return zoomed.groupBy(*KEYS, "z", "y", "x").agg(F.max("v").alias("v"))


def quantize(volumes: DataFrame) -> DataFrame:
    """Values as grey levels, truncated; zeros have no row."""
    return volumes.withColumn("p", to_grey(F.col("v").cast("double"))).drop("v").where("p > 0")


def nuclei(voxels: DataFrame, sizes: DataFrame) -> DataFrame:
    """The whole extraction: grey-level cubes (image, label, z, y, x, p) of all accepted labels."""
    windows = cut(crop_windows(bounding_boxes(voxels)))
    # Written once, as percentiles and values both read them.
    own = cut(isolate(voxels, windows))
    placed = place_depth(stretch(own, percentiles(own)), sizes)
    return quantize(merge_depth(zoom(placed, bounded(cut(zoom_taps(windows))))))


def number_nuclei(accepted: DataFrame) -> DataFrame:
    """Dense ids from 0 in the order of image and label.

    Labels are ranked within their image; only one row per image is summed up
    in order.
    """
    running = Window.orderBy("image").rowsBetween(Window.unboundedPreceding, -1)
    per_image = accepted.groupBy("image").agg(F.count("*").alias("n"))
    first = per_image.select("image", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy("image").orderBy("label")) - 1
    return accepted.withColumn("own", own).join(first, "image").select("image", "label", (F.col("first") + F.col("own")).alias("nucleus_id"))


def nuclei_per_image(accepted: DataFrame) -> DataFrame:
    """Nuclei by image and the running total in the order of images."""
    counts = accepted.groupBy("image").agg(F.count("*").alias("nuclei"))
    return counts.withColumn("total", F.sum("nuclei").over(Window.orderBy("image").rowsBetween(Window.unboundedPreceding, 0)))
