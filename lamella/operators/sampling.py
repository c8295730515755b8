"""Around a reconstruction model: inputs from crops, outputs to volumes, training samples and the loss."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions.constants import DEPTH
from lamella.functions.expr import clamp, f32
from lamella.session import hashed


def _levels(crops: DataFrame, key: str) -> DataFrame:
    p = F.percentile("p", F.array(F.lit(0.02), F.lit(0.98)))
    return crops.groupBy(key).agg(F.min("p").alias("lo"), F.max("p").alias("hi"), p.alias("ps"))


def contrast_stretch(crops: DataFrame, key: str = "crop_index") -> DataFrame:
    """Pixels between the 2nd and 98th percentile as grey levels, truncated; a flat crop is zero."""
    out = crops.join(_levels(crops, key), key)
    low, high = F.col("ps")[0], F.col("ps")[1]
    level = ((clamp(F.col("p").cast("double"), low, high) - low) / (high - low + 1e-6) * 255).cast("smallint")
    return out.select(key, "y", "x", F.when(F.col("hi") > F.col("lo"), level).otherwise(F.lit(0).cast("smallint")).alias("p"))


def foreground_mask(crops: DataFrame, key: str = "crop_index", share: float = 0.1) -> DataFrame:
    """1 where a raw pixel exceeds the minimum by ``share`` of the range."""
    out = crops.join(_levels(crops, key).select(key, "lo", "hi"), key)
    limit = F.col("lo") + (F.col("hi") - F.col("lo")) * share
    return out.select(key, "y", "x", (F.col("p") > limit).cast("int").alias("m"))


_MODELS: dict[str, Callable] = {}


class Lazy:
    """A model that each worker makes once, when it is first called; only its name and maker are sent to workers."""

    def __init__(self, name: str, make: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]]):
        self.name, self.make = name, make

    def __call__(self, image: np.ndarray, mask: np.ndarray) -> np.ndarray:
        if self.name not in _MODELS:
            _MODELS[self.name] = self.make()
        return _MODELS[self.name](image, mask)


def run_model(crops: DataFrame, model: Callable[[np.ndarray, np.ndarray], np.ndarray], key: str = "crop_index", failures: bool = False) -> DataFrame:
    """Hook for an external model: image and mask of each crop in, occupied voxels (key, z, y, x, v) out.

    A model that fails ends the job, or, with ``failures``, gives one row of
    its crop with the reason in error and no voxel; the other crops go on.
    """
    image = contrast_stretch(crops, key).withColumnRenamed("p", "level")
    both = image.join(foreground_mask(crops, key), [key, "y", "x"])

    def call(frame: pd.DataFrame) -> pd.DataFrame:
        shape = (int(frame["y"].max()) + 1, int(frame["x"].max()) + 1)
        level, mask = np.zeros(shape, np.uint8), np.zeros(shape, np.uint8)
        level[frame["y"], frame["x"]], mask[frame["y"], frame["x"]] = frame["level"], frame["m"]
        name = frame[key].iloc[0]
        try:
            volume = model(np.repeat(level[..., None], 3, axis=2), mask)
            z, y, x = np.nonzero(volume)
            out = pd.DataFrame({key: name, "z": z, "y": y, "x": x, "v": volume[z, y, x].astype("float32")})
            return out.assign(error=None) if failures else out
        except Exception as error:  # noqa: BLE001  whatever a model raises is its crop's reason
            if not failures:
                raise
            return pd.DataFrame({key: [name], "z": [None], "y": [None], "x": [None], "v": [None], "error": [f"{type(error).__name__}: {error}"[:200]]})

    kind = crops.schema[key].dataType.simpleString()
    return both.groupBy(key).applyInPandas(call, f"{key} {kind}, z int, y int, x int, v float" + (", error string" if failures else ""))


def first_mesh(inputs: DataFrame, meshes: DataFrame, key: str) -> DataFrame:
    """The first of each input's meshes (key, ordinal, success): (key, ordinal, error); error says why there is none."""
    found = meshes.groupBy(key).agg(F.min(F.struct("ordinal", "success")).alias("m"))
    error = F.when(F.col("m").isNull(), "no mesh returned").when(~F.coalesce(F.col("m.success"), F.lit(False)), "mesh extraction unsuccessful")
    return inputs.select(key).distinct().join(found, key, "left").select(key, F.when(error.isNull(), F.col("m.ordinal")).alias("ordinal"), error.alias("error"))


def index_bounds(ids: DataFrame, key: str) -> DataFrame:
    """(lo, hi) of valid positions in a list of the ids, from 0; hi is -1 without any."""
    return ids.agg(F.lit(0).cast("long").alias("lo"), (F.countDistinct(key) - 1).alias("hi"))


def center_paste(voxels: DataFrame, sizes: DataFrame, keys: list[str], size: int = DEPTH) -> DataFrame:
    """Volumes of any size in the middle of a cube, cut where they are larger; sizes has keys, sz, sy, sx.

    The shift is the floor of half the difference, also where that is negative.
    """
    out = voxels.join(hashed(sizes), keys)
    for a in "zyx":
        out = out.withColumn(a, (F.col(a) + F.floor((size - F.col(f"s{a}")) / 2.0)).cast("int")).where(F.col(a).between(0, size - 1))
    return out.drop("sz", "sy", "sx")


class PointGrid:
    """Points by the cell of a regular grid, for searches of the nearest in growing shells of cells."""

    def __init__(self, points: np.ndarray):
        self.low = points.min(0)
        many = max(1, round(len(points) ** (1 / 3)))
        self.side = float(max((points.max(0) - self.low).max() / many, 1e-12))
        self.many = np.maximum(((points.max(0) - self.low) // self.side).astype(np.int64) + 1, 1)
        code = self._code(self._cell(points))
        self.order = np.argsort(code, kind="stable")
        self.points, self.code = points[self.order], code[self.order]

    def _cell(self, at: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((at - self.low) / self.side), 0, self.many - 1).astype(np.int64)

    def _code(self, cell: np.ndarray) -> np.ndarray:
        return (cell[..., 0] * self.many[1] + cell[..., 1]) * self.many[2] + cell[..., 2]

    def nearest(self, ask: np.ndarray) -> np.ndarray:
        """Numbers of the nearest points; of equally near ones the smallest."""
        best, found = np.full(len(ask), np.inf), np.full(len(ask), len(self.points), np.int64)
        cell, open_ = self._cell(ask), np.arange(len(ask))
        # How far a point outside of the grid is from the cell it was put in.
        reach = np.maximum(self.low + cell * self.side - ask, ask - (self.low + (cell + 1) * self.side)).max(1)
        for ring in range(int(self.many.max()) + 1):
            if not len(open_):
                break
            steps = np.array([s for s in np.ndindex(*[2 * ring + 1] * 3) if max(abs(x - ring) for x in s) == ring]) - ring
            for step in steps:
                near = cell[open_] + step
                inside = ((near >= 0) & (near < self.many)).all(1)
                rows, codes = open_[inside], self._code(near[inside])
                a, z = np.searchsorted(self.code, codes, "left"), np.searchsorted(self.code, codes, "right")
                n = z - a
                rows, a, n = rows[n > 0], a[n > 0], n[n > 0]
                if not len(rows):
                    continue
                first = np.cumsum(n) - n
                at = np.repeat(a - first, n) + np.arange(n.sum())
                d = ask[np.repeat(rows, n)] - self.points[at]
                d = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
                least = np.minimum.reduceat(d, first)
                own = np.where(d == np.repeat(least, n), self.order[at], len(self.points))
                number = np.minimum.reduceat(own, first)
                better = (least < best[rows]) | ((least == best[rows]) & (number < found[rows]))
                best[rows[better]], found[rows[better]] = least[better], number[better]
            # All points of further shells are at least so far along one axis, whatever the rounding.
            sure = np.maximum(ring * self.side + np.minimum(-reach[open_], 0), 0) * (1 - 1e-9) - 1e-12
            open_ = open_[best[open_] >= np.maximum(sure, 0) ** 2]
        return found


def nearest_vertex(voxels: DataFrame, vertices: DataFrame, key: str = "mesh_id", size: int = DEPTH) -> DataFrame:
    """Intensity of the vertex nearest to each occupied voxel (key, z, y, x, vertex_id, intensity).

    A voxel (z, y, x) asks at ((z, y, x) + 0.5) / size - 0.5 against vertices
    (x, y, z), axes as they come. Ties go to the smaller vertex_id. A mesh has
    size ** 3 voxels at most; voxels and vertices of a mesh meet once, and the
    vertices are searched by a grid. Voxels of a mesh without vertices have none.
    """
    kinds = vertices.schema["vertex_id"].dataType.simpleString()
    schema = f"{key} {voxels.schema[key].dataType.simpleString()}, z int, y int, x int, vertex_id {kinds}, intensity double"

    def search(cells: pa.Table, points: pa.Table) -> pa.Table:
        points = points.sort_by("vertex_id") if len(points) else points
        if not len(cells) or not len(points):
            return pa.table({key: cells.column(key).slice(0, 0), **{a: pa.array([], pa.int32()) for a in "zyx"}, "vertex_id": points.column("vertex_id").slice(0, 0), "intensity": pa.array([], pa.float64())})
        at = np.column_stack([cells.column(a).to_numpy() for a in "zyx"]).astype(float)
        grid = PointGrid(np.column_stack([points.column(a).to_numpy() for a in "xyz"]).astype(float))
        ask = (at + 0.5) / float(size) - 0.5
        found = pa.array(np.concatenate([grid.nearest(ask[i : i + 65_536]) for i in range(0, len(ask), 65_536)]))
        return pa.table({key: cells.column(key), **{a: cells.column(a).cast(pa.int32()) for a in "zyx"}, "vertex_id": points.column("vertex_id").take(found), "intensity": points.column("intensity").cast(pa.float64()).take(found)})

    return voxels.select(key, "z", "y", "x").groupBy(key).cogroup(vertices.select(key, "vertex_id", "x", "y", "z", "intensity").groupBy(key)).applyInArrow(search, schema)


def blur_taps(sigma: float = 0.8, truncate: float = 4.0) -> list[tuple[int, float]]:
    """Offsets and weights of a Gaussian cut off after ``truncate`` sigmas."""
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * k * k / (sigma * sigma)) for k in range(-radius, radius + 1)]
    return [(k - radius, w / sum(raw)) for k, w in enumerate(raw)]


def _blurred(volume: np.ndarray, there: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """The blurred volume, and which of its voxels any voxel that is there reaches."""
    for axis in range(3):
        at = np.arange(volume.shape[axis])
        taps = [(np.clip(at + k, 0, len(at) - 1), w) for k, w in blur_taps(sigma)]
        volume = sum(np.take(volume, where, axis) * w for where, w in taps)
        there = np.logical_or.reduce([np.take(there, where, axis) for where, _ in taps])
    return volume, there


def gaussian_blur(voxels: DataFrame, key: str, shape: tuple[int, int, int], sigma: float = 0.8) -> DataFrame:
    """Three passes, one an axis, edges repeated; then values from 0 to 1. Absent voxels are zero.

    A volume has a fixed size, so each is blurred as one array: voxels move once.
    """
    schema = f"{key} {voxels.schema[key].dataType.simpleString()}, z int, y int, x int, v float"

    def blur(table: pa.Table) -> pa.Table:
        at = tuple(table.column(a).to_numpy().astype(np.int64) for a in "zyx")
        volume, there = np.zeros(shape), np.zeros(shape, bool)
        np.add.at(volume, at, table.column("v").to_numpy())
        there[at] = True
        volume, there = _blurred(volume, there, sigma)
        places = np.nonzero(there)
        name = table.column(key).combine_chunks().slice(0, 1)
        values = np.clip(volume[places], 0.0, 1.0).astype(np.float32)
        return pa.table([name.take(pa.array(np.zeros(len(values), np.int64))), *[pa.array(p.astype(np.int32)) for p in places], pa.array(values)], names=[key, "z", "y", "x", "v"])

    return voxels.select(key, "z", "y", "x", F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("v")).groupBy(key).applyInArrow(blur, schema)


def best_slice(voxels: DataFrame, key: str = "nucleus_id", threshold: float = 0.1) -> DataFrame:
    """The slice with most voxels above the threshold, the first on ties; without any, slice 0."""
    counts = voxels.groupBy(key, "z").agg(F.count_if(F.col("v") > f32(threshold)).alias("n"))
    best = counts.groupBy(key).agg(F.max(F.struct("n", (-F.col("z")).alias("up"))).alias("b"))
    return best.select(key, F.when(F.col("b.n") > 0, -F.col("b.up")).otherwise(0).cast("int").alias("best_z"), F.col("b.n").alias("n"))


def train_images(voxels: DataFrame, key: str = "nucleus_id", threshold: float = 0.1) -> DataFrame:
    """Grey levels and mask (0 or 255) of each nucleus' best slice."""
    out = voxels.join(best_slice(voxels, key, threshold).select(key, F.col("best_z").alias("z")), [key, "z"])
    level = (F.col("v") * f32(255.0)).cast("smallint")
    return out.select(key, "y", "x", level.alias("level"), F.when(F.col("v") > f32(threshold), 255).otherwise(0).alias("mask"))


def resize_nearest(image: DataFrame, key: str, value: str, size_in: int, size_out: int) -> DataFrame:
    """Output pixel j shows input floor((j + 0.5) * size_in / size_out)."""
    rows = [(j, int((j + 0.5) * size_in / size_out)) for j in range(size_out)]
    taps = lambda out, at: F.broadcast(image.sparkSession.createDataFrame(rows, f"{out} int, {at} int"))
    return image.join(taps("r", "y"), "y").join(taps("c", "x"), "x").select(key, "r", "c", value)


def bicubic_taps(size_in: int, size_out: int, a: float = -0.5) -> list[tuple[int, int, float]]:
    """(output, input, weight) of cubic convolution, weights adding up to 1 within the image."""

    def cubic(d: float) -> float:
        d = abs(d)
        if d < 1:
            return ((a + 2) * d - (a + 3)) * d * d + 1
        return ((d - 5) * d + 8) * d * a - 4 * a if d < 2 else 0.0

    scale = size_in / size_out
    wide = max(scale, 1.0)
    rows = []
    for j in range(size_out):
        centre = (j + 0.5) * scale
        lo, hi = max(0, int(centre - 2 * wide + 0.5)), min(size_in, int(centre + 2 * wide + 0.5))
        own = [cubic((k - centre + 0.5) / wide) for k in range(lo, hi)]
        rows += [(j, k, w / sum(own)) for k, w in zip(range(lo, hi), own)]
    return rows


def resize_bicubic(image: DataFrame, key: str, value: str, size_in: int, size_out: int) -> DataFrame:
    """Columns first, then rows, each rounded to whole grey levels."""
    rows = bicubic_taps(size_in, size_out)
    taps = lambda out, at: F.broadcast(image.sparkSession.createDataFrame(rows, f"{out} int, {at} int, w double"))
    level = lambda: clamp(F.floor(F.round(F.sum(F.col(value) * F.col("w")), 9) + 0.5), 0, 255).cast("int").alias(value)
    wide = image.join(taps("c", "x"), "x").groupBy(key, "y", "c").agg(level())
    return wide.join(taps("r", "y"), "y").groupBy(key, "r", "c").agg(level())


def never_empty(mask: DataFrame, key: str, value: str, at: int) -> DataFrame:
    """A mask without any pixel gets one at (at, at)."""
    top = mask.groupBy(key).agg(F.max(value).alias("top"))
    lone = (F.col("top") == 0) & (F.col("r") == at) & (F.col("c") == at)
    return mask.join(top, key).withColumn(value, F.when(lone, 255).otherwise(F.col(value))).drop("top")


def pointmap(spark, height: int, width: int, depth: float = 5.0) -> DataFrame:
    """A flat map of points at one depth, x and y from -1 to 1."""
    out = spark.range(height).select(F.col("id").cast("int").alias("r")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    return out.select("r", "c", (-1.0 + 2.0 * F.col("c") / (width - 1)).alias("px"), (-1.0 + 2.0 * F.col("r") / (height - 1)).alias("py"), F.lit(depth).alias("pz"))


def rgba(image: DataFrame, level: str = "level", mask: str = "mask") -> DataFrame:
    """Grey level three times, and the mask as alpha."""
    return image.withColumn("rgba", F.array(level, level, level, mask))


def collate(samples: DataFrame) -> DataFrame:
    """Scale 1 and shift 0 where a sample has none."""
    return samples.withColumns({"scale": F.coalesce("scale", F.lit(1.0)), "shift": F.coalesce("shift", F.lit(0.0))})


def bce_loss(logits: DataFrame, *keys: str) -> DataFrame:
    """Mean binary cross-entropy of logits x against targets t, in the form that can't overflow."""
    each = F.greatest(F.col("x"), F.lit(0.0)) - F.col("x") * F.col("t") + F.log1p(F.exp(-F.abs("x")))
    return logits.groupBy(*keys).agg(F.avg(each).alias("loss"))


def _shuffled(key: str, seed: int) -> Column:
    """Where an id comes in the order of a seed."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def batches(ids: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """Rows in a shuffled order fixed by ``seed``, in batches of ``size``, the last one smaller; place is that in the batch.

    The order is that of a hash. Rows are counted by its first digits, and
    ranked within these alone, so no global sort is needed; with a seed for each
    epoch every epoch has other batches.
    """
    rows = ids.withColumn("__h", _shuffled(key, seed)).withColumn("__part", F.substring("__h", 1, 3))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # At most 4096 rows.
    first = rows.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy("__h", key)) - 1
    out = rows.withColumn("__own", own).join(F.broadcast(first), "__part").withColumn("__at", F.col("__first") + F.col("__own"))
    return out.withColumns({"batch": F.floor(F.col("__at") / size).cast("long"), "place": (F.col("__at") % size).cast("int")}).drop("__h", "__part", "__first", "__own", "__at")


def pick_random(ids: DataFrame, key: str, seed: int, n: int = 1) -> DataFrame:
    """``n`` rows drawn uniformly, repeatable by seed."""
    return ids.orderBy(_shuffled(key, seed), key).limit(n)
