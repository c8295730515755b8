"""Binary array files as rows: npy crops, nuclei and masks, HDF5 images, CSV metadata."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.operators.extract import voxel_sizes

NAMES = ["path", "item", "z", "depth", "height", "width", "pixels", "error"]
#: What an unreadable file raises; its row holds the reason, and the others go on.
UNREADABLE = (ValueError, OSError, EOFError, KeyError, TypeError, AttributeError, MemoryError, RuntimeError)
#: Files of more bytes are opened by their path on the worker and not handed over by Spark, whose rows end at 2 GB.
LARGE = 1 << 30


def planes_type(floats: bool) -> str:
    return f"path string, item long, z int, depth int, height int, width int, pixels array<{'double' if floats else 'int'}>, error string"


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Paths of all files under a folder, at any depth; nothing is read of them."""
    return _files(spark, path, pattern).select("path")


def _contents(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    files = _files(spark, path, pattern)
    small = files.where(F.col("length") <= LARGE).select("path", "content")
    return small.unionByName(files.where(F.col("length") > LARGE).select("path", F.lit(None).cast("binary").alias("content")))


def _open(path: str, content: bytes | None):
    """A file to read and seek in; a large one from any store that pyarrow knows."""
    if content is not None:
        return io.BytesIO(content)
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(path)
    return store.open_input_file(where)


def _values(plane: np.ndarray, floats: bool) -> list:
    if floats:
        return plane.ravel().astype(float).tolist()
    if plane.dtype.kind == "f" and not np.array_equal(plane, np.trunc(plane)):
        raise ValueError("fractions in an array that is read as whole numbers")
    return plane.ravel().astype(int).tolist()


def _planes(path: str, array: np.ndarray, kind: str, floats: bool) -> Iterator[tuple]:
    """One row per 2D plane: of (N, H, W) crops or (N, Z, H, W, 1) volumes, or of one (Z, H, W) volume."""
    if array.ndim == 5:
        array = array[..., 0]
    if array.ndim == 3:
        array = array[None] if kind == "volume" else array[:, None]
    if array.ndim != 4:
        raise ValueError(f"{array.ndim} dimensions")
    for item in range(array.shape[0]):
        for z in range(array.shape[1]):
            plane = array[item, z]
            yield path, item, z, array.shape[1], *plane.shape, _values(plane, floats), None


def _decoded(make, floats: bool):
    """Rows of the planes that ``make`` yields of a path and an open file, some hundred at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    with _open(path, content) as file:
                        made = make(path, file)
                        while rows := [r for _, r in zip(range(256), made)]:
                            yield pd.DataFrame(rows, columns=NAMES)
                except UNREADABLE as error:
                    yield pd.DataFrame([(path, *[None] * 6, str(error)[:200] or type(error).__name__)], columns=NAMES)

    return run


def read_npy(spark: SparkSession, path: str, kind: str = "items", floats: bool = False, pattern: str = "*.npy") -> DataFrame:
    """Planes of all npy files under a path; an unreadable file gives one row with its error, and pickles are refused.

    A 3D array is a list of crops, or, of ``kind`` "volume", one volume or mask.
    ``floats`` keeps fractions, which otherwise make a file unreadable.
    """

    def make(path, file):
        return _planes(path, np.load(io.BytesIO(file.read()), allow_pickle=False), kind, floats)

    return _contents(spark, path, pattern).mapInPandas(_decoded(make, floats), planes_type(floats))


def good(planes: DataFrame) -> DataFrame:
    return planes.where("error is null").drop("error")


def errors(planes: DataFrame) -> DataFrame:
    """Files that were skipped, and why."""
    return planes.where("error is not null").select("path", "error")


def pixels(planes: DataFrame, kind: str = "smallint") -> DataFrame:
    """Planes as pixel rows (item, z, y, x, p), p being of the given type."""
    rows = planes.select("item", "z", "width", F.posexplode("pixels").alias("pos", "p"))
    return rows.select("item", "z", F.floor(F.col("pos") / F.col("width")).cast("int").alias("y"), (F.col("pos") % F.col("width")).cast("int").alias("x"), F.col("p").cast(kind).alias("p"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with a header; ordinal is the line's place, by file and then by line, for the last of repeated indices to win.

    A file is read as a whole, so that its lines keep their order.
    """

    def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                own = pd.read_csv(io.BytesIO(content), dtype=str, keep_default_na=False, na_values=[""])
                blank = pd.Series([None] * len(own), dtype=object)
                yield pd.DataFrame({"path": name, "line": range(len(own)), **{c: own[c] if c in own else blank for c in ("crop_index", "classes")}})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = files.mapInPandas(lines, "path string, line long, crop_index string, classes string")
    return found.select("crop_index", "classes", F.struct("path", "line").alias("ordinal"))


EXTENT_KEYS = ("ExtMin0", "ExtMax0", "X", "ExtMin2", "ExtMax2", "Z")
EXTENTS = "path string, known boolean, x_min string, x_max string, x_size string, z_min string, z_max string, z_size string, error string"


def _read_extents(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import h5py  # not everywhere installed; needed for this source alone

    def attribute(info, key: str) -> str | None:
        try:
            return "".join(c.decode("ascii") for c in info.attrs[key])
        except (KeyError, UnicodeDecodeError, AttributeError, TypeError):
            return None

    for frame in frames:
        rows = []
        for path, content in zip(frame["path"], frame["content"]):
            try:
                with _open(path, content) as file, h5py.File(file, "r") as data:
                    info = data.get("DataSetInfo/Image")
                    rows.append((path, info is not None, *[None if info is None else attribute(info, k) for k in EXTENT_KEYS], None))
            except UNREADABLE as error:
                rows.append((path, *[None] * 7, str(error)[:200] or type(error).__name__))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in EXTENTS.split(", ")])


def read_extents(spark: SparkSession, path: str) -> DataFrame:
    """Extent attributes of image files, as text, for ``operators.extract.voxel_sizes``; a broken file has its error."""
    return _contents(spark, path, "*.ims").mapInPandas(_read_extents, EXTENTS)


def read_images(spark: SparkSession, path: str, channel: int = 0, floats: bool = False) -> DataFrame:
    """Planes of one channel at full resolution and time 0 of all image files under a path; a broken file has its error."""

    def make(path, file):
        import h5py

        with h5py.File(file, "r") as data:
            volume = data[f"DataSet/ResolutionLevel 0/TimePoint 0/Channel {channel}/Data"]
            for z in range(volume.shape[0]):
                plane = np.asarray(volume[z])
                yield path, 0, z, volume.shape[0], *plane.shape, _values(plane, floats), None

    return _contents(spark, path, "*.ims").mapInPandas(_decoded(make, floats), planes_type(floats))


def find_pairs(files: DataFrame) -> DataFrame:
    """Images (path) with a mask beside them: (path, mask_path), sorted. The suffix alone is replaced."""
    images = files.where(F.endswith("path", F.lit(".ims"))).select("path", F.regexp_replace("path", r"\.ims$", "_mask.npy").alias("mask_path"))
    return images.join(files.select(F.col("path").alias("mask_path")).distinct(), "mask_path", "left_semi").select("path", "mask_path").orderBy("path")


def ingest_errors(pairs: DataFrame, images: DataFrame, masks: DataFrame) -> DataFrame:
    """Images (path) of ``pairs`` that are left out, each with one reason: itself, then its mask, then unequal shapes."""
    mine = errors(images).groupBy("path").agg(F.min("error").alias("image_error"))
    other = errors(masks).groupBy(F.col("path").alias("mask_path")).agg(F.min("error").alias("mask_error"))
    shape = lambda planes, name: good(planes).groupBy("path").agg(F.max(F.struct("depth", "height", "width")).alias(name))
    both = pairs.join(mine, "path", "left").join(other, "mask_path", "left")
    both = both.join(shape(images, "a"), "path", "left").join(shape(masks, "b").withColumnRenamed("path", "mask_path"), "mask_path", "left")
    unequal = F.when(F.col("a").eqNullSafe(F.col("b")), None).otherwise("the mask has another shape")
    return both.select("path", F.coalesce("image_error", "mask_error", unequal).alias("error")).where("error is not null")


def labelled_voxels(pairs: DataFrame, images: DataFrame, masks: DataFrame) -> DataFrame:
    """Image and mask side by side, plane by plane: (image, label, z, y, x, i) of all voxels that have a label.

    Both arrays of a plane are in one row, so pixels are never joined. Images in
    ``ingest_errors`` are left out.
    """
    usable = pairs.join(ingest_errors(pairs, images, masks).select("path"), "path", "left_anti")
    one = good(images).select("path", "z", "width", F.col("pixels").alias("i"))
    two = good(masks).select(F.col("path").alias("mask_path"), "z", F.col("pixels").alias("label"))
    rows = usable.join(one, "path").join(two, ["mask_path", "z"])
    cells = rows.select(F.col("path").alias("image"), "z", "width", F.posexplode(F.arrays_zip("label", "i")).alias("pos", "cell")).where("cell.label > 0")
    return cells.select("image", F.col("cell.label").alias("label"), "z", F.floor(F.col("pos") / F.col("width")).cast("int").alias("y"), (F.col("pos") % F.col("width")).cast("int").alias("x"), F.col("cell.i").alias("i"))


def ingest(spark: SparkSession, path: str, channel: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All pairs of image and mask under a folder: labelled voxels, voxel sizes by image, and what was left out.

    ``operators.extract.nuclei`` makes cubes of the first two.
    """
    pairs = find_pairs(list_files(spark, path))
    images, masks = read_images(spark, path, channel), read_npy(spark, path, "volume", pattern="*_mask.npy")
    extents = read_extents(spark, path)
    left_out = ingest_errors(pairs, images.select("path", "depth", "height", "width", "error").unionByName(extents.where("error is not null").select("path", *[F.lit(None).cast("int").alias(c) for c in ("depth", "height", "width")], "error")), masks)
    voxels = labelled_voxels(pairs, images, masks).join(left_out.select(F.col("path").alias("image")), "image", "left_anti")
    return voxels, voxel_sizes(extents.where("error is null")).withColumnRenamed("path", "image"), left_out
