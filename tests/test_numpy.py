"""Operators against plain numpy written from their formulas, on small random volumes."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.functions.constants import GAUSSIAN, HIDE_ABOVE, HIDE_BELOW, LINEAR, SHOW_ALL
from lamella.operators import extract, labels, mesh, reconstruct, sampling, slicing
from lamella.plans import explorer
from lamella.sources import arrays, sinks


def rows_of(volume, key=1):
    return [(key, int(z), int(y), int(x), float(volume[z, y, x])) for z, y, x in np.ndindex(volume.shape)]


def frame(spark, volumes):
    rows = [r for k, v in volumes.items() for r in rows_of(v, k)]
    return spark.createDataFrame(rows, "nucleus_id long, z int, y int, x int, v float")


def dense(df, shape, key=1):
    out = np.zeros(shape, np.float32)
    for r in df.where(F.col("nucleus_id") == key).collect():
        out[r.z, r.y, r.x] = r.v
    return out


def sparse_slices(rng, depth, density):
    volume = rng.random((depth, 3, 2)).astype(np.float32) * 0.009
    for z in np.flatnonzero(rng.random(depth) < density):
        volume[z] = rng.random((3, 2))
    return volume


def numpy_fill(volume, threshold=0.01):
    out = volume.copy()
    signal = [z for z in range(len(volume)) if volume[z].max() > np.float32(threshold)]
    for a, b in zip(signal, signal[1:]):
        for z in range(a + 1, b):
            t = (z - a) / (b - a)
            out[z] = ((1 - t) * volume[a].astype(float) + t * volume[b].astype(float)).astype(np.float32)
    return out


def test_gap_fill(spark):
    rng = np.random.default_rng(3)
    volumes = {k: sparse_slices(rng, 12, d) for k, d in enumerate([0.0, 0.1, 0.3, 0.3, 0.6, 1.0])}
    got = reconstruct.fill_gaps(frame(spark, volumes))
    for k, v in volumes.items():
        assert np.array_equal(dense(got, v.shape, k), numpy_fill(v)), k
    assert got.count() == sum(v.size for v in volumes.values())


@pytest.mark.parametrize("threshold", [0.2, 0.4, 0.6, 0.8])
def test_threshold_is_single_precision(spark, threshold):
    levels = spark.range(256).select(F.lit(1).alias("k"), (F.col("id") / 255).cast("float").alias("v"))
    want = int((np.arange(256, dtype=np.float32) / np.float32(255) > np.float32(threshold)).sum())
    assert mesh.active_voxels(levels, threshold).count() == want


def basis(azimuth, elevation, offset, centre):
    t, p = math.radians(azimuth), math.radians(elevation)
    n = np.array([math.cos(p) * math.cos(t), math.cos(p) * math.sin(t), math.sin(p)])
    up = np.array([0.0, 1.0, 0.0]) if abs(n[2]) > 0.99 else np.array([0.0, 0.0, 1.0])
    u = np.cross(up, n)
    u = u / (np.linalg.norm(u) + 1e-8)
    return n, np.array(centre) + offset * n, u, np.cross(n, u)


@pytest.mark.parametrize("elevation", [25.0, 81.0, 82.0, 90.0, -90.0])
def test_plane_and_slice(spark, elevation):
    rng = np.random.default_rng(5)
    shape, centre = (7, 6, 5), (2.5, 3.0, 3.5)
    volume = rng.random(shape).astype(np.float32)
    view = explorer.View(37.0, elevation, 0.5)
    n, p0, u, v = basis(37.0, elevation, 0.5, centre)
    row = explorer.plane_of(spark, view, centre).first()
    assert np.allclose([[row[f"{k}{a}"] for a in "xyz"] for k in "npuv"], [n, p0, u, v], atol=1e-12)
    assert abs(np.dot(n, u)) < 1e-12
    size = 12
    want = np.zeros((size, size))
    for r, c in np.ndindex(size, size):
        x, y, z = p0 + (c - size // 2) * u + (r - size // 2) * v
        if 0 <= x <= 4 and 0 <= y <= 5 and 0 <= z <= 6:
            for dz, dy, dx in np.ndindex(2, 2, 2):
                at = (int(z) + dz, int(y) + dy, int(x) + dx)
                w = (1 - abs(z - at[0])) * (1 - abs(y - at[1])) * (1 - abs(x - at[2]))
                if w > 0 and all(i < n for i, n in zip(at, shape)):
                    want[r, c] += w * volume[at]
    got = np.zeros((size, size))
    for q in explorer.slice_view(frame(spark, {1: volume}), view, "nucleus_id", centre, shape, size).collect():
        got[q.r, q.c] = q.v
    assert np.allclose(got, want, atol=1e-6)


def test_separable_slice_equals_general(spark):
    crop = np.random.default_rng(8).integers(0, 256, (6, 5))
    crops = spark.createDataFrame([(1, y, x, int(crop[y, x])) for y, x in np.ndindex(6, 5)], "nucleus_id long, y int, x int, p int")
    plane = explorer.plane_of(spark, explorer.View(20.0, 40.0, 1.0), (2.5, 3.0, 32.0))
    points = slicing.sample_grid(plane, (64, 6, 5), 20)
    a = slicing.oblique_slice(reconstruct.extrude(crops, GAUSSIAN), points, "nucleus_id").collect()
    b = slicing.oblique_slice_extruded(crops, points, "nucleus_id", GAUSSIAN).collect()
    a, b = ({(r.r, r.c): r.v for r in x} for x in (a, b))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_clips_share_the_volume(spark):
    volume = np.random.default_rng(9).random((5, 5, 5)).astype(np.float32) + 0.1
    df = frame(spark, {1: volume})
    view = lambda m: explorer.View(0.0, 0.0, 0.0, m)
    above, below, every = (dense(explorer.clipped(df, view(m), (2.0, 2.0, 2.0)), volume.shape) for m in (HIDE_ABOVE, HIDE_BELOW, SHOW_ALL))
    assert np.array_equal(every, volume)
    both = (above > 0).astype(int) + (below > 0)
    assert (both[..., 2] == 2).all() and (both.sum() == 125 + 25)
    assert not above[..., 3:].any() and not below[..., :2].any()


def test_mesh_counts_and_empty(spark):
    volume = np.zeros((3, 3, 3), np.float32)
    volume[0, 1, 2] = volume[2, 0, 0] = 0.5
    vertices, faces, bounds = explorer.mesh_view(frame(spark, {1: volume, 2: volume * 0}), explorer.View(), "nucleus_id", (1.5, 1.5, 1.5))
    v = vertices.orderBy("vertex_no").collect()
    assert len(v) == 16 and faces.count() == 24
    assert (v[0].vx, v[0].vy, v[0].vz) == (1.5, 0.5, -0.5) and [r.vertex_no for r in v] == list(range(16))
    assert {(r.nucleus_id, r.v_min, r.v_max) for r in bounds.collect()} == {(1, 0.5, 0.5), (2, 0.0, 1.0)}
    assert faces.agg(F.max("vi"), F.max("vj"), F.max("vk")).first()[0] == 15


def test_linear_weights(spark):
    one = spark.createDataFrame([(1, 0, 0, 255)], "nucleus_id long, y int, x int, p int")
    for thickness in (1, 16, 32):
        got = dense(reconstruct.extrude(one, LINEAR, thickness=thickness), (64, 1, 1)).ravel()
        want = np.maximum(0, 1 - np.abs(np.arange(64) - 32) / (thickness / 2)).astype(np.float32)
        assert np.array_equal(got, want)
    assert not dense(reconstruct.extrude(one, "unknown"), (64, 1, 1)).any()


def test_blur(spark):
    volume = np.random.default_rng(4).random((5, 4, 3)).astype(np.float32)
    out = volume.astype(float)
    taps = sampling.blur_taps(0.8)
    for axis in range(3):
        n = out.shape[axis]
        out = sum(w * np.take(out, np.clip(np.arange(n) + k, 0, n - 1), axis) for k, w in taps)
    got = dense(sampling.gaussian_blur(frame(spark, {1: volume}), "nucleus_id", volume.shape), volume.shape)
    assert len(taps) == 7 and np.allclose(got, out, atol=1e-6)


def test_extraction(spark):
    rng = np.random.default_rng(6)
    label = np.zeros((9, 40, 40), int)
    label[2:7, 1:12, 3:13] = 1
    label[3:8, 20:33, 25:38] = 3
    label[0:2, 20:35, 2:15] = 2  # too thin
    image = rng.integers(50, 900, label.shape)
    rows = [(0, int(label[i]), *map(int, i), int(image[i])) for i in np.ndindex(label.shape) if label[i]]
    voxels = spark.createDataFrame(rows, "image int, label int, z int, y int, x int, i int")
    sizes = spark.createDataFrame([(0, 0.3, 0.15)], "image int, res_z double, res_x double")
    got = extract.nuclei(voxels, sizes).toPandas()
    assert set(got["label"]) == {1, 3}
    for k in (1, 3):
        z, y, x = np.nonzero(label == k)
        h, w, d = np.ptp(y) + 1, np.ptp(x) + 1, np.ptp(z) + 1
        s = 2 * max(h, w)
        y0, x0 = (int(round((a.min() + a.max() + 1) / 2 - s / 2)) for a in (y, x))
        own = np.zeros((d, s, s), np.float32)
        own[z - z.min(), y - y0, x - x0] = image[z, y, x]
        lo, hi = np.percentile(image[z, y, x], [1, 99])
        inside = np.zeros(own.shape, bool)
        inside[z - z.min(), y - y0, x - x0] = True
        own = np.where(inside, np.clip((own - lo) / (hi - lo), 0, 1), 0).astype(np.float32)
        cube = np.zeros((64, 64, 64), np.float32)
        at = np.arange(64) * (s - 1) / 63
        low = np.floor(at).astype(int)
        part = at - low
        high = np.minimum(low + 1, s - 1)
        for i in range(d):
            zi = int(round(31.5 + (i - (d - 1) / 2) * (0.3 / (s * 0.15 / 64))))
            if 0 <= zi < 64:
                row = own[i][low] * (1 - part)[:, None] + own[i][high] * part[:, None]
                cube[zi] = np.maximum(cube[zi], row[:, low] * (1 - part) + row[:, high] * part)
        want = np.clip(cube * 255, 0, 255).astype(np.uint8)
        out = np.zeros((64, 64, 64), int)
        mine = got[got.label == k]
        out[mine.z, mine.y, mine.x] = mine.p
        assert np.abs(out - want).max() <= 1 and (out != want).mean() < 1e-4


def test_metadata_file(spark, tmp_path):
    (tmp_path / "m.csv").write_text("crop_index,classes\n1,B cells\nx,nerves\n 3 ,tumor cells\n1,plasma cells\n5\n1_0,stroma\n")
    got = labels.consolidate(labels.clean_metadata(arrays.read_metadata(spark, str(tmp_path / "m.csv"))), "classes")
    assert {(r.crop_index, r.cell_class) for r in got.collect()} >= {(1, "B cells"), (3, "Neoplastic cells")}
    assert not {10} & {r.crop_index for r in got.collect()}


def test_npy_files(spark, tmp_path):
    crops = np.random.default_rng(1).integers(0, 256, (3, 4, 5)).astype(np.uint8)
    np.save(tmp_path / "crops.npy", crops)
    np.save(tmp_path / "pickled.npy", np.array([{}], dtype=object), allow_pickle=True)
    (tmp_path / "broken.npy").write_bytes(b"not an array")
    planes = arrays.read_npy(spark, str(tmp_path))
    assert arrays.errors(planes).count() == 2
    got = np.zeros_like(crops)
    for r in arrays.pixels(arrays.good(planes)).collect():
        got[r.item, r.y, r.x] = r.p
    assert np.array_equal(got, crops)


def test_save_and_load(spark, tmp_path):
    volume = np.random.default_rng(2).random((3, 2, 2)).astype(np.float32)
    df = frame(spark, {1: volume})
    assert sinks.save_planes(df, str(tmp_path / "v")) and not sinks.save_planes(df.limit(0), str(tmp_path / "w"))
    back = sinks.load_planes(spark.read.parquet(str(tmp_path / "v"))).withColumnRenamed("value", "v")
    assert np.array_equal(dense(back, volume.shape), volume) and not (tmp_path / "w").exists()


def test_model_hook(spark):
    crops = spark.createDataFrame([(k, y, x, 10 * y + x) for k in (1, 2) for y, x in np.ndindex(4, 4)], "crop_index long, y int, x int, p int")

    def model(image, mask):
        assert image.shape == (4, 4, 3) and mask.max() == 1
        return np.ones((2, 2, 2)) * mask.sum()

    got = sampling.run_model(crops, model).collect()
    assert len(got) == 16 and len({r.v for r in got}) == 1


def test_voxel_sizes(spark):
    rows = [("a", True, "0", "64", "128", "0", "10", "5"), ("b", False, *[None] * 6), ("c", True, "x", "2", "0", None, "3", "-1")]
    df = spark.createDataFrame(rows, "path string, known boolean, x_min string, x_max string, x_size string, z_min string, z_max string, z_size string")
    assert {(r.path, r.res_z, r.res_x) for r in extract.voxel_sizes(df).collect()} == {("a", 2.0, 0.5), ("b", 1.0, 1.0), ("c", 1.0, 1.0)}


def test_rgba(spark):
    df = spark.createDataFrame([(7, 255)], "level int, mask int")
    assert sampling.rgba(df).first().rgba == [7, 7, 7, 255]




STUB = '''
import io
import numpy as np


class _Group:
    def __init__(self, attrs):
        self.attrs = attrs


class File:
    """Stands for the HDF5 reader: an npz with the data sets and attributes of an image."""

    def __init__(self, file, mode):
        try:
            self.own = dict(np.load(io.BytesIO(file.read()), allow_pickle=False))
        except Exception as error:
            raise OSError("truncated file") from error

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass

    def __getitem__(self, key):
        return self.own[key]

    def get(self, key):
        return _Group({k[1:]: [bytes([b]) for b in v] for k, v in self.own.items() if k[0] == "@"}) if "info" in self.own else None
'''


def write_image(path, volume=None, **attributes):
    key = "DataSet/ResolutionLevel 0/TimePoint 0/Channel 0/Data"
    own = {f"@{k}": np.frombuffer(v.encode(), np.uint8) for k, v in attributes.items()}
    if attributes:
        own["info"] = np.zeros(1)
    if volume is not None:
        own[key] = volume
    with open(path, "wb") as file:
        np.savez(file, **own)


def test_files_to_nuclei(spark, tmp_path):
    """Pairs of image and mask to cubes; everything that can't be read is reported, the rest goes on."""
    try:
        import h5py  # noqa: F401

        pytest.skip("the stub would hide the reader")
    except ImportError:
        pass
    from lamella.session import ship

    ship(spark)
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "h5py.py").write_text(STUB)
    spark.sparkContext.addPyFile(str(tmp_path / "lib" / "h5py.py"))
    rng = np.random.default_rng(9)
    root = tmp_path / "data"
    (root / "deep").mkdir(parents=True)
    volume = rng.integers(100, 60_000, (6, 40, 44)).astype(np.uint16)
    mask = np.zeros((6, 40, 44), np.int32)
    mask[1:5, 5:17, 8:20] = 1
    mask[0:4, 20:30, 25:36] = 70_000
    mask[2, 1, 1] = 3
    known = {"ExtMin0": "0", "ExtMax0": "4.4", "X": "44", "ExtMin2": "0", "ExtMax2": "1.2", "Z": "6"}
    write_image(root / "good.ims", volume, **known)
    np.save(root / "good_mask.npy", mask)
    write_image(root / "deep" / "plain.ims", volume)
    np.save(root / "deep" / "plain_mask.npy", mask)
    (root / "broken.ims").write_bytes(b"not a file of this kind")
    np.save(root / "broken_mask.npy", mask)
    write_image(root / "empty.ims", None, **known)
    np.save(root / "empty_mask.npy", mask)
    write_image(root / "pickled.ims", volume, **known)
    np.save(root / "pickled_mask.npy", np.array([{"a": 1}], object), allow_pickle=True)
    write_image(root / "shape.ims", volume, **known)
    np.save(root / "shape_mask.npy", mask[:, :-1])
    write_image(root / "alone.ims", volume, **known)

    voxels, sizes, left_out = arrays.ingest(spark, str(root))
    name = lambda p: p.rsplit("/", 1)[1]
    assert sorted(name(r.path) for r in arrays.list_files(spark, str(root), "*.ims").collect()) == ["alone.ims", "broken.ims", "empty.ims", "good.ims", "pickled.ims", "plain.ims", "shape.ims"]
    assert {name(r.path): r.error[:12] for r in left_out.collect()} == {"broken.ims": "truncated fi", "empty.ims": "'DataSet/Res", "pickled.ims": "Object array", "shape.ims": "the mask has"}
    assert {name(r.image): (round(r.res_z, 9), round(r.res_x, 9)) for r in sizes.collect() if name(r.image) in ("good.ims", "plain.ims")} == {"good.ims": (0.2, 0.1), "plain.ims": (1.0, 1.0)}
    got = {(name(r.image), r.label, r.z, r.y, r.x): r.i for r in voxels.collect()}
    want = {(f, int(mask[p]), *map(int, p)): int(volume[p]) for f in ("good.ims", "plain.ims") for p in zip(*np.nonzero(mask))}
    assert got == want
    cubes = extract.nuclei(voxels, sizes).groupBy("image", "label").agg(F.count("*").alias("n"), F.max("p").alias("p")).collect()
    assert sorted((name(r.image), r.label) for r in cubes) == [(f, n) for f in ("good.ims", "plain.ims") for n in (1, 70_000)]
    assert all(r.n > 500 and r.p > 200 for r in cubes), cubes


def test_kinds_of_arrays(spark, tmp_path):
    volume = np.linspace(0, 1, 24).reshape(2, 3, 4).astype(np.float32)
    np.save(tmp_path / "v.npy", volume)
    (failed,) = arrays.errors(arrays.read_npy(spark, str(tmp_path), "volume")).collect()
    assert "fractions" in failed.error
    planes = arrays.good(arrays.read_npy(spark, str(tmp_path), "volume", floats=True))
    got = {(r.item, r.z, r.y, r.x): r.p for r in arrays.pixels(planes, "float").collect()}
    assert got == {(0, z, y, x): float(volume[z, y, x]) for z, y, x in np.ndindex(volume.shape)}
    crops = arrays.good(arrays.read_npy(spark, str(tmp_path), floats=True)).collect()
    assert sorted((r.item, r.z, r.depth) for r in crops) == [(0, 0, 1), (1, 0, 1)]


def test_metadata_of_several_files(spark, tmp_path):
    """The last line wins, in the order of files and lines, however Spark splits them."""
    (tmp_path / "a.csv").write_text("classes,crop_index\nB cells,1\n" + "nerves,2\n" * 2000)
    (tmp_path / "b.csv").write_text("crop_index,classes\n1,stroma\n1,tumor cells\n")
    clean = labels.clean_metadata(arrays.read_metadata(spark, str(tmp_path)))
    assert {(r.crop_index, r.classes) for r in clean.collect()} == {(1, "tumor cells"), (2, "nerves")}


def test_reconstruction_by_dataset(spark):
    rng = np.random.default_rng(2)
    crop = rng.integers(0, 256, (3, 4))
    crops = spark.createDataFrame([(5, y, x, int(crop[y, x])) for y, x in np.ndindex(crop.shape)], "crop_index long, y int, x int, p int")
    for mode in (GAUSSIAN, LINEAR):
        a = explorer.reconstruction("CODEX", crops, mode).collect()
        assert sorted(a) == sorted(reconstruct.extrude(crops, mode, sparse=True).collect()) and a
    stored = spark.createDataFrame([(5, 1, 2, 3, 0.5)], "nucleus_id long, z int, y int, x int, v float")
    assert explorer.reconstruction("CODEX", crops, "IA", ai=stored).where("v > 0").count() == 1
    with pytest.raises(ValueError):
        explorer.reconstruction("CODEX", crops, "IA")
    with pytest.raises(ValueError):
        explorer.reconstruction("ELSE", crops)
    unknown = reconstruct.extrude(crops, "ELSE")
    assert unknown.count() == 64 * crop.size and unknown.where("v <> 0").count() == 0
    slices = spark.createDataFrame([(1, z, 0, 0, p) for z, p in ((0, 100), (4, 200))], "nucleus_id long, z int, y int, x int, p int")
    plain = {r.z: r.v for r in explorer.reconstruction("RESTORE", slices).collect()}
    filled = {r.z: r.v for r in explorer.reconstruction("RESTORE", slices, LINEAR).collect() if r.v > 0}
    assert sorted(plain) == [0, 4] and sorted(filled) == [0, 1, 2, 3, 4]


def test_model_failures_and_lazy_models(spark, tmp_path):
    from lamella.session import ship

    ship(spark)
    crops = spark.createDataFrame([(i, y, x, 10 * i + y + x) for i in range(4) for y in range(3) for x in range(3)], "crop_index long, y int, x int, p int")
    log = str(tmp_path / "made")

    def make():
        with open(log, "a") as file:
            file.write(f"{os.getpid()}\n")
        return lambda image, mask: np.ones((2, 2, 2))

    got = sampling.run_model(crops, sampling.Lazy("test", make), failures=True).collect()
    assert len(got) == 4 * 8 and all(r.error is None and r.v == 1.0 for r in got)
    with open(log) as file:
        made = file.read().split()
    assert made and len(made) == len(set(made))

    def broken(image, mask):
        raise ValueError("no surface")

    failed = sampling.run_model(crops, broken, failures=True).collect()
    assert sorted((r.crop_index, r.error) for r in failed) == [(i, "ValueError: no surface") for i in range(4)]


def test_batches_are_exact(spark):
    ids = spark.range(103).withColumnRenamed("id", "nucleus_id")
    got = sampling.batches(ids, "nucleus_id", 10, 3).collect()
    assert sorted((r.batch, r.place) for r in got) == [(n // 10, n % 10) for n in range(103)] and len({r.nucleus_id for r in got}) == 103
    other = {(r.nucleus_id, r.batch) for r in sampling.batches(ids, "nucleus_id", 10, 4).collect()}
    assert other != {(r.nucleus_id, r.batch) for r in got}
