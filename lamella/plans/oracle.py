"""DuckDB SQL for the voxel queries, written from the definitions and not from the DataFrame code.

A statement names the common tables it needs; ``sql`` puts their definitions,
and those that they need in turn, before it.
"""

from __future__ import annotations

import re

from lamella.functions.constants import CLASS_MAP, CORNERS, FACES, MICRONS, UNKNOWN
from lamella.operators.sampling import bicubic_taps, blur_taps
from lamella.sources.fixtures import CUTS, DIRTY, EXTENTS, IMAGES, MASKS, PATHS, RAW_CLASSES


def values(rows, columns: str) -> str:
    def one(x):
        return "NULL" if x is None else repr(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS v({columns})"


def r(expr: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0"


def _extent(axis: str) -> str:
    number = lambda c, default: f"coalesce(try_cast({axis}_{c} AS DOUBLE), {default})"
    return r(f"CASE WHEN known AND {number('size', 1.0)} > 0 THEN ({number('max', 1.0)} - {number('min', 0.0)}) / {number('size', 1.0)} ELSE 1.0 END")


def by_slice(table: str, key: str) -> str:
    return f"SELECT {key}, z, count(*) AS voxels, {r('sum(CAST(v AS DOUBLE))', 4)} AS total, {r('max(v)', 5)} AS peak FROM {table} GROUP BY {key}, z"


def planes(cx: float, cy: float, cz: float) -> str:
    return f"""
  SELECT *, ny * uz - nz * uy AS vx, nz * ux - nx * uz AS vy, nx * uy - ny * ux AS vz FROM (
    SELECT *, rx / (sqrt(rx * rx + ry * ry + rz * rz) + 1e-8) AS ux, ry / (sqrt(rx * rx + ry * ry + rz * rz) + 1e-8) AS uy, rz / (sqrt(rx * rx + ry * ry + rz * rz) + 1e-8) AS uz FROM (
      SELECT *, {cx} + slice_offset * nx AS px, {cy} + slice_offset * ny AS py, {cz} + slice_offset * nz AS pz,
             CASE WHEN abs(nz) > 0.99 THEN nz ELSE -ny END AS rx, CASE WHEN abs(nz) > 0.99 THEN 0.0::DOUBLE ELSE nx END AS ry, CASE WHEN abs(nz) > 0.99 THEN -nx ELSE 0.0::DOUBLE END AS rz FROM (
        SELECT *, cos(radians(elevation)) * cos(radians(azimuth)) AS nx, cos(radians(elevation)) * sin(radians(azimuth)) AS ny, sin(radians(elevation)) AS nz FROM cuts)))"""


def extruded(weight: str) -> str:
    return f"SELECT crop_index, z, y, x, CAST(CAST(p / 255.0::DOUBLE AS FLOAT) * ({weight}) AS FLOAT) AS v FROM crops, depths"


def clipped(side: str) -> str:
    return f"""SELECT crop_index, z, y, x, CASE WHEN (x - 4.0::DOUBLE) * nx + (y - 4.0::DOUBLE) * ny + (z - 32.0::DOUBLE) * nz - slice_offset {side} 0 THEN 0.0::FLOAT ELSE v END AS v
  FROM gaussian, (SELECT * FROM local_planes WHERE cut = 0)"""


def filled(threshold: float) -> str:
    return f"""
  SELECT v.nucleus_id, v.z, v.y, v.x, v.v FROM raw v WHERE NOT EXISTS (SELECT 1 FROM ({gaps(threshold)}) g WHERE g.nucleus_id = v.nucleus_id AND g.z = v.z)
  UNION ALL
  SELECT g.nucleus_id, g.z, a.y, a.x, CAST((1 - g.alpha) * CAST(a.v AS DOUBLE) + g.alpha * CAST(b.v AS DOUBLE) AS FLOAT) AS v
  FROM ({gaps(threshold)}) g JOIN raw a ON a.nucleus_id = g.nucleus_id AND a.z = g.z1 JOIN raw b ON b.nucleus_id = g.nucleus_id AND b.z = g.z2 AND b.y = a.y AND b.x = a.x"""


def gaps(threshold: float) -> str:
    return f"""SELECT nucleus_id, z1, z2, z, (z - z1) / CAST(z2 - z1 AS DOUBLE) AS alpha FROM (
      SELECT nucleus_id, z1, z2, unnest(range(z1 + 1, z2)) AS z FROM (
        SELECT nucleus_id, z AS z1, lead(z) OVER (PARTITION BY nucleus_id ORDER BY z) AS z2 FROM (
          SELECT nucleus_id, z FROM raw GROUP BY nucleus_id, z HAVING max(v) > CAST({threshold} AS FLOAT))) WHERE z2 IS NOT NULL)"""


def blur_pass(source: str, axis: str, n: int) -> str:
    others = [a for a in "zyx" if a != axis]
    taps = ", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in blur_taps())
    return f"SELECT nucleus_id, {', '.join(others)}, o AS {axis}, sum(v * w) AS v FROM {source} JOIN (SELECT o, least(greatest(o + k, 0), {n - 1}) AS s, w FROM range({n}) t(o), (VALUES {taps}) AS taps(k, w)) ON s = {axis} GROUP BY nucleus_id, {', '.join(others)}, o"


TABLES = {
    "crops": "SELECT vec_id AS crop_index, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x, CAST(least(255, floor(abs(CAST(embedding[i] AS DOUBLE)) * 510)) AS INTEGER) AS p FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)",
    "metadata": f"SELECT vec_id AS crop_index, {RAW_CLASSES!r}[label % 10 + 1] AS raw_class FROM embeddings WHERE vec_id % 11 <> 0",
    "class_map": values(CLASS_MAP.items(), "raw, mapped"),
    "classes": "SELECT crop_index, coalesce(mapped, raw_class) AS cell_class FROM metadata LEFT JOIN class_map ON raw = raw_class",
    "cuts": values(CUTS, "cut, azimuth, elevation, slice_offset").replace("SELECT *", "SELECT cut, CAST(azimuth AS DOUBLE) AS azimuth, CAST(elevation AS DOUBLE) AS elevation, CAST(slice_offset AS DOUBLE) AS slice_offset"),
    "planes": planes(32.0, 32.0, 32.0),
    "local_planes": planes(4.0, 4.0, 32.0),
    "depths": "SELECT range AS z FROM range(64)",
    "gaussian": extruded("exp(-((z - 32) * (z - 32)) / (2.0::DOUBLE * 2.5 * 2.5))"),
    "linear": extruded("CASE WHEN abs(z - 32) < 8.0 THEN 1.0::DOUBLE - abs(z - 32) / 8.0::DOUBLE ELSE 0.0 END"),
    "above": clipped(">"),
    "below": clipped("<"),
    "slices": "SELECT crop_index // 5 AS nucleus_id, CAST((crop_index % 5) * 13 + (crop_index // 5) % 4 + 2 AS INTEGER) AS z, y, x, p FROM crops",
    "raw": "SELECT nucleus_id, z, y, x, CAST(p / 255.0::DOUBLE AS FLOAT) AS v FROM slices",
    "filled": filled(0.01),
    "filled_train": filled(0.05),
    "numbered": "SELECT *, row_number() OVER (PARTITION BY crop_index ORDER BY z, y, x) - 1 AS n FROM above WHERE v > CAST(0.05 AS FLOAT)",
    "points": """
  SELECT * FROM (
    SELECT cut, r, c, px + (c - 45) * ux + (r - 45) * vx AS sx, py + (c - 45) * uy + (r - 45) * vy AS sy, pz + (c - 45) * uz + (r - 45) * vz AS sz
    FROM local_planes, range(90) a(r), range(90) b(c))
  WHERE sx BETWEEN 0 AND 7 AND sy BETWEEN 0 AND 7 AND sz BETWEEN 0 AND 63""",
    "taps": """
  SELECT cut, r, c, CAST(floor(sz) AS BIGINT) + dz AS z, CAST(floor(sy) AS BIGINT) + dy AS y, CAST(floor(sx) AS BIGINT) + dx AS x,
         CASE dz WHEN 0 THEN 1 - (sz - floor(sz)) ELSE sz - floor(sz) END AS wz, CASE dy WHEN 0 THEN 1 - (sy - floor(sy)) ELSE sy - floor(sy) END AS wy, CASE dx WHEN 0 THEN 1 - (sx - floor(sx)) ELSE sx - floor(sx) END AS wx
  FROM points, range(2) i(dz), range(2) j(dy), range(2) k(dx)""",
    "cut_filled": "SELECT cut, nucleus_id, r, c, CAST(sum(v * wz * wy * wx) AS FLOAT) AS v FROM filled JOIN taps USING (z, y, x) GROUP BY ALL",
    "cut_raw": "SELECT cut, nucleus_id, r, c, CAST(sum(v * wz * wy * wx) AS FLOAT) AS v FROM raw JOIN taps USING (z, y, x) GROUP BY ALL",
    "cut_gaussian": "SELECT cut, crop_index, r, c, CAST(sum(p / 255.0::DOUBLE * exp(-((z - 32) * (z - 32)) / 12.5::DOUBLE) * wz * wy * wx) AS FLOAT) AS v FROM crops JOIN taps USING (y, x) GROUP BY ALL",
    "supplied": "SELECT CAST(s_suppkey AS INTEGER) AS s, CAST(s_suppkey // 16 AS INTEGER) AS image, CAST(s_suppkey % 16 AS INTEGER) AS t, CAST(s_suppkey % 4 AS INTEGER) AS rz, CAST(3 + s_suppkey % 5 AS INTEGER) AS ry, CAST(4 + s_suppkey % 3 AS INTEGER) AS rx FROM supplier",
    "label_voxels": """
  SELECT image, label, z, y, x, 100 + (31 * x + 17 * y + 7 * z + 13 * s) % 900 AS i FROM (
    SELECT image, t + 1 AS label, 8 + dz AS z, (t // 4) * 40 + CASE WHEN t < 4 THEN 6 ELSE 20 END + dy AS y, (t % 4) * 40 + 20 + dx AS x, s
    FROM supplied, range(-3, 4) a(dz), range(-7, 8) b(dy), range(-6, 7) c(dx)
    WHERE abs(dz) <= rz AND abs(dy) <= ry AND abs(dx) <= rx AND dy * dy * rx * rx + dx * dx * ry * ry <= rx * rx * ry * ry)
  WHERE y >= 0 AND x >= 0""",
    "sizes": "SELECT DISTINCT image, 0.15::DOUBLE * CAST([0.25, 1, 2, 4][CAST(image % 4 + 1 AS INTEGER)] AS DOUBLE) AS res_z, 0.15::DOUBLE AS res_x FROM label_voxels",
    "boxes": "SELECT image, label, min(z) AS z0, max(z) + 1 AS z1, min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1 FROM label_voxels GROUP BY image, label HAVING max(z) + 1 - min(z) >= 3 AND max(y) + 1 - min(y) >= 8 AND max(x) + 1 - min(x) >= 8",
    "windows": """
  SELECT *, CAST(round_even((y0 + y1) / 2.0::DOUBLE - s_new / 2.0::DOUBLE, 0) AS INTEGER) AS y_start, CAST(round_even((x0 + x1) / 2.0::DOUBLE - s_new / 2.0::DOUBLE, 0) AS INTEGER) AS x_start
  FROM (SELECT *, 2 * greatest(y1 - y0, x1 - x0) AS s_new FROM boxes)""",
    "isolated": "SELECT image, label, s_new, z1 - z0 AS depth, z - z0 AS d, y - y_start AS ly, x - x_start AS lx, i FROM label_voxels JOIN windows USING (image, label)",
    "limits": "SELECT * FROM (SELECT image, label, quantile_cont(CAST(i AS DOUBLE), 0.01) AS lo, quantile_cont(CAST(i AS DOUBLE), 0.99) AS hi FROM isolated GROUP BY image, label) WHERE hi > lo",
    "stretched": "SELECT image, label, s_new, depth, d, ly, lx, CAST(least(greatest((i - lo) / (hi - lo), 0.0::DOUBLE), 1.0::DOUBLE) AS FLOAT) AS v FROM isolated JOIN limits USING (image, label)",
    "placed": """
  SELECT * FROM (SELECT *, CAST(round_even(31.5::DOUBLE + (d - (depth - 1) / 2.0::DOUBLE) * (res_z / (s_new * res_x / 64.0::DOUBLE)), 0) AS INTEGER) AS z FROM stretched JOIN sizes USING (image)) WHERE z BETWEEN 0 AND 63""",
    "zoom_taps": """
  SELECT s_new, j, k, w FROM (
    SELECT s_new, j, CAST(floor(a) AS BIGINT) + e AS k, CASE e WHEN 0 THEN 1 - (a - floor(a)) ELSE a - floor(a) END AS w
    FROM (SELECT s_new, j, j * (s_new - 1) / 63.0::DOUBLE AS a FROM (SELECT DISTINCT s_new FROM windows), range(64) t(j)), range(2) u(e)) WHERE w > 0""",
    "zoomed": "SELECT image, label, d, z, ty.j AS y, tx.j AS x, CAST(sum(CAST(v AS DOUBLE) * ty.w * tx.w) AS FLOAT) AS v FROM placed p JOIN zoom_taps ty ON ty.s_new = p.s_new AND ty.k = p.ly JOIN zoom_taps tx ON tx.s_new = p.s_new AND tx.k = p.lx GROUP BY image, label, d, z, ty.j, tx.j",
    "cubes": "SELECT image, label, z, y, x, CAST(trunc(least(greatest(CAST(max(v) AS DOUBLE) * 255, 0), 255)) AS BIGINT) AS p FROM zoomed GROUP BY image, label, z, y, x",
    "levels": "SELECT crop_index, min(p) AS lo, max(p) AS hi, quantile_cont(CAST(p AS DOUBLE), 0.02) AS p2, quantile_cont(CAST(p AS DOUBLE), 0.98) AS p98 FROM crops GROUP BY crop_index",
    "vertices": "SELECT label AS mesh_id, vec_id AS vertex_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, abs(CAST(embedding[4] AS DOUBLE)) AS intensity FROM embeddings",
    "occupied": "SELECT mesh_id, z, y, x FROM (SELECT DISTINCT label AS mesh_id FROM embeddings), range(0, 61, 4) a(z), range(0, 61, 4) b(y), range(0, 61, 4) c(x) WHERE (z + y + x + mesh_id) % 3 = 0",
    "logits": "SELECT vec_id AS nucleus_id, CAST(embedding[i] AS DOUBLE) AS x, CASE WHEN floor(abs(CAST(embedding[i] AS DOUBLE)) * 510) > 25 THEN 1.0::DOUBLE ELSE 0.0 END AS t FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)",
    "losses": "SELECT nucleus_id, greatest(x, 0) - x * t + ln(1 + exp(-abs(x))) AS loss FROM logits",
    "blur_z": blur_pass("(SELECT nucleus_id, z, y, x, CAST(v AS DOUBLE) AS v FROM raw)", "z", 64),
    "blur_y": blur_pass("blur_z", "y", 8),
    "blur_x": blur_pass("blur_y", "x", 8),
    "blurred": "SELECT nucleus_id, z, y, x, CAST(least(greatest(v, 0), 1) AS FLOAT) AS v FROM blur_x",
    "best": "SELECT nucleus_id, CASE WHEN n > 0 THEN z ELSE 0 END AS best_z, n FROM (SELECT nucleus_id, z, count(*) FILTER (v > CAST(0.1 AS FLOAT)) AS n FROM filled_train GROUP BY nucleus_id, z) QUALIFY row_number() OVER (PARTITION BY nucleus_id ORDER BY n DESC, z) = 1",
    "trained": "SELECT v.nucleus_id, y, x, CAST(trunc(v * CAST(255 AS FLOAT)) AS INTEGER) AS level, CASE WHEN v > CAST(0.1 AS FLOAT) THEN 255 ELSE 0 END AS mask FROM filled_train v JOIN best b ON b.nucleus_id = v.nucleus_id AND b.best_z = v.z",
    "cubic": values(bicubic_taps(8, 65), "o, k, w").replace("SELECT *", "SELECT o, k, CAST(w AS DOUBLE) AS w"),
    "wide": "SELECT nucleus_id, y, o AS c, least(greatest(floor(round(sum(level * w), 9) + 0.5), 0), 255) AS level FROM trained JOIN cubic ON k = x GROUP BY nucleus_id, y, o",
    "bicubic": "SELECT nucleus_id, o AS r, c, CAST(least(greatest(floor(round(sum(level * w), 9) + 0.5), 0), 255) AS BIGINT) AS level FROM wide JOIN cubic ON k = y GROUP BY nucleus_id, o, c",
}


def sql(statement: str) -> str:
    needed: list[str] = []

    def need(text: str) -> None:
        for name in TABLES:
            if name not in needed and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                need(TABLES[name])
                needed.append(name)

    need(statement)
    return ("WITH " + ",\n".join(f"{n} AS ({TABLES[n]})" for n in needed) + "\n" if needed else "") + statement


def image_sums(table: str, key: str) -> str:
    return f"SELECT cut, {key}, count(*) FILTER (v <> 0) AS lit, {r('sum(CAST(v AS DOUBLE))', 4)} AS total, {r('sum(CAST(v AS DOUBLE) * (r % 7 + 1) * (c % 5 + 1))', 3)} AS mixed FROM {table} GROUP BY cut, {key}"


def blown_up(table: str, factor: int) -> str:
    return f"(SELECT cut, nucleus_id, r * {factor} + i AS r, c * {factor} + j AS c, v FROM {table}, range({factor}) a(i), range({factor}) b(j))"


_CORNERS = values([(n, *c) for n, c in enumerate(CORNERS)], "k, dx, dy, dz")
_FACES = values([(n, *f) for n, f in enumerate(FACES)], "k, i, j, l")

STATEMENTS = {
    "flagship": f"SELECT label, count(*) AS voxels, {r('min(v)')} AS v_min, {r('max(v)')} AS v_max FROM above JOIN embeddings ON vec_id = crop_index WHERE v > CAST(0.05 AS FLOAT) GROUP BY label",
    "scan_crops": "SELECT crop_index, y, x, p FROM crops",
    "scan_nuclei": "SELECT nucleus_id, z, y, x, p FROM slices",
    "metadata_clean": f"SELECT crop_index, coalesce(mapped, classes) AS cell_class FROM (SELECT TRY_CAST(trim(crop_index) AS INTEGER) AS crop_index, arg_max_null(classes, ordinal) AS classes FROM ({values(DIRTY, 'ordinal, crop_index, classes')}) WHERE TRY_CAST(trim(crop_index) AS INTEGER) IS NOT NULL GROUP BY 1) LEFT JOIN class_map ON raw = classes",
    "voxel_size": f"""
SELECT CAST(image AS VARCHAR) AS path, {r('res_z')} AS res_z, {r('res_x')} AS res_x FROM sizes
UNION ALL
SELECT path, {_extent('z')} AS res_z, {_extent('x')} AS res_x FROM ({values(EXTENTS, 'path, known, x_min, x_max, x_size, z_min, z_max, z_size')})""",
    "ingest_errors": f"""
SELECT a.path, CASE WHEN a.error IS NOT NULL THEN a.error WHEN b.error IS NOT NULL THEN b.error ELSE 'the mask has another shape' END AS error
FROM ({values(IMAGES, 'path, d, h, w, error')}) a JOIN ({values(MASKS, 'path, d, h, w, error')}) b ON b.path = replace(a.path, '.ims', '_mask.npy')
WHERE a.error IS NOT NULL OR b.error IS NOT NULL OR (a.d, a.h, a.w) <> (b.d, b.h, b.w)""",
    "first_mesh": """
SELECT vec_id AS crop_index, CASE WHEN vec_id % 5 <> 0 AND (vec_id + vec_id % 3) % 4 <> 0 THEN vec_id % 3 ELSE -1 END AS ordinal,
       CASE WHEN vec_id % 5 = 0 THEN 'no mesh returned' WHEN (vec_id + vec_id % 3) % 4 = 0 THEN 'mesh extraction unsuccessful' END AS error
FROM embeddings""",
    "index_bounds": "SELECT CAST(0 AS BIGINT) AS lo, count(DISTINCT vec_id // 5) - 1 AS hi FROM embeddings",
    "volume_centre": "SELECT image, (max(x) + 1) / 2.0 AS cx, (max(y) + 1) / 2.0 AS cy, (max(z) + 1) / 2.0 AS cz FROM label_voxels GROUP BY image",
    "shuffle_batches": """
SELECT nucleus_id, n // 16 AS batch, CAST(n % 16 AS INTEGER) AS place
FROM (SELECT nucleus_id, row_number() OVER (ORDER BY md5('1:' || nucleus_id)) - 1 AS n FROM (SELECT DISTINCT vec_id // 5 AS nucleus_id FROM embeddings))""",
    "random_nucleus": "SELECT nucleus_id FROM (SELECT DISTINCT vec_id // 5 AS nucleus_id FROM embeddings) ORDER BY md5('1:' || nucleus_id) LIMIT 1",
    "file_pairs": f"WITH files AS ({values([(p,) for p in PATHS], 'path')}) SELECT a.path, b.path AS mask_path FROM files a JOIN files b ON a.path LIKE '%.ims' AND b.path = substr(a.path, 1, length(a.path) - 4) || '_mask.npy'",
    "nuclei_count": "SELECT count(DISTINCT nucleus_id) AS nuclei FROM slices",
    "crop_lookup": "SELECT crop_index, y, x, p FROM crops WHERE crop_index = 7",
    "normalize_u8": f"SELECT crop_index, y, x, {r('CAST(p / 255.0::DOUBLE AS FLOAT)')} AS v FROM crops",
    "class_consolidate": "SELECT crop_index, cell_class FROM classes",
    "class_or_unknown": f"SELECT DISTINCT crop_index, coalesce(cell_class, '{UNKNOWN}') AS cell_class FROM crops LEFT JOIN classes USING (crop_index)",
    "signal_slices": f"SELECT nucleus_id, z, {r('max(v)')} AS peak FROM raw GROUP BY nucleus_id, z HAVING max(v) > CAST(0.01 AS FLOAT)",
    "signal_slice_counts": "SELECT nucleus_id, count(*) AS slices FROM (SELECT nucleus_id, z FROM raw GROUP BY nucleus_id, z HAVING max(v) > CAST(0.2 AS FLOAT)) GROUP BY nucleus_id",
    "active_voxels": by_slice("(SELECT * FROM raw WHERE v > CAST(0.2 AS FLOAT))", "nucleus_id"),
    "clip_above": by_slice("above", "crop_index"),
    "clip_below": by_slice("below", "crop_index"),
    "recon_gaussian": by_slice("gaussian", "crop_index"),
    "recon_linear": by_slice("linear", "crop_index"),
    "recon_none": by_slice("(SELECT crop_index, 32 AS z, CAST(p / 255.0::DOUBLE AS FLOAT) AS v FROM crops)", "crop_index"),
    "restore_raw": by_slice("raw", "nucleus_id"),
    "gap_fill": by_slice("filled", "nucleus_id"),
    "gap_fill_train": by_slice("filled_train", "nucleus_id"),
    "ai_or_zero": by_slice("(SELECT nucleus_id, z, y, x, CASE WHEN z = 5 AND nucleus_id % 2 = 0 THEN CAST(p / 255.0::DOUBLE AS FLOAT) ELSE 0.0::FLOAT END AS v FROM (SELECT crop_index AS nucleus_id, y, x, p FROM crops), range(8) t(z))", "nucleus_id"),
    "plane_basis": "SELECT cut, " + ", ".join(f"{r(k + a, 9)} AS {k}{a}" for k in "npuv" for a in "xyz") + " FROM planes",
    "plane_wireframe": "SELECT cut, ordinal, " + ", ".join(f"{r(f'p{a} + 20 * su * u{a} + 20 * sv * v{a}')} AS {a}" for a in "xyz") + " FROM planes, (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1), (4, -1, -1)) AS s(ordinal, su, sv)",
    "axis_ticks": f"SELECT dataset, CAST(t AS INTEGER) AS tick, format('{{:.1f}}', t * CAST(scale AS DOUBLE)) AS label FROM ({values(MICRONS.items(), 'dataset, scale')}), range(0, 65, 16) u(t)",
    "mesh_vertices": "SELECT crop_index, count(*) AS vertices, max(n * 8 + k) AS last, " + ", ".join(f"{r(f'sum(CAST({a} + d{a} AS DOUBLE) * ((n * 8 + k) % 97))', 3)} AS sum_{a}" for a in "xyz") + f", {r('sum(CAST(v AS DOUBLE))', 3)} AS sum_c FROM numbered, ({_CORNERS}) GROUP BY crop_index",
    "mesh_faces": "SELECT crop_index, count(*) AS faces, max(n * 12 + k) AS last, " + ", ".join(f"CAST(sum((n * 8 + {c}) * ((n * 12 + k) % 89)) AS BIGINT) AS sum_{a}" for a, c in zip("ijk", "ijl")) + f" FROM numbered, ({_FACES}) GROUP BY crop_index",
    "mesh_bounds": f"SELECT crop_index, {r('coalesce(min(v) FILTER (v > CAST(0.2 AS FLOAT)), 0)', 5)} AS v_min, {r('coalesce(max(v) FILTER (v > CAST(0.2 AS FLOAT)), 1)', 5)} AS v_max, count(*) FILTER (v > CAST(0.2 AS FLOAT)) AS active FROM above GROUP BY crop_index",
    "oblique_slice": image_sums("cut_filled", "nucleus_id"),
    "oblique_slice_extruded": image_sums("cut_gaussian", "crop_index"),
    "upscale_8x": image_sums(blown_up("cut_raw", 8), "nucleus_id"),
    "upscale_4x": "SELECT crop_index, count(*) AS pixels, CAST(sum(p) AS BIGINT) AS total, CAST(sum(p * ((y * 4 + i) * 3 + x * 4 + j)) AS BIGINT) AS mixed FROM crops, range(4) a(i), range(4) b(j) GROUP BY crop_index",
    "slice_montage": """SELECT nucleus_id, count(*) AS pixels, max((x + 8 * place) * 2 + j) + 1 AS width, CAST(sum(p * ((y * 2 + i) * 3 + (x + 8 * place) * 2 + j)) AS BIGINT) AS mixed
FROM slices JOIN (SELECT nucleus_id, z, row_number() OVER (PARTITION BY nucleus_id ORDER BY z) - 1 AS place FROM (SELECT nucleus_id, z FROM raw GROUP BY nucleus_id, z HAVING max(v) > CAST(0.2 AS FLOAT))) USING (nucleus_id, z), range(2) a(i), range(2) b(j) GROUP BY nucleus_id""",
    "nucleus_bbox": "SELECT image, label, z0, z1, y0, y1, x0, x1 FROM boxes",
    "crop_window": "SELECT image, label, s_new, y_start, x_start FROM windows",
    "label_isolate": "SELECT image, label, d, ly, lx, i FROM isolated",
    "nucleus_percentiles": f"SELECT image, label, {r('lo')} AS lo, {r('hi')} AS hi FROM limits",
    "nucleus_normalize": f"SELECT image, label, d, ly, lx, {r('v', 5)} AS v FROM stretched",
    "z_place": "SELECT DISTINCT image, label, d, z FROM placed",
    "xy_zoom": f"SELECT image, label, d, count(*) FILTER (v > 1e-6) AS lit, {r('sum(CAST(v AS DOUBLE))', 3)} AS total, {r('sum(CAST(v AS DOUBLE) * (y + 2 * x))', 1)} AS mixed FROM zoomed GROUP BY image, label, d",
    "quantize_u8": "SELECT image, label, z, count(*) AS voxels, CAST(sum(p) AS BIGINT) AS total FROM cubes WHERE p > 0 GROUP BY image, label, z",
    "nucleus_ids": "SELECT image, label, row_number() OVER (ORDER BY image, label) - 1 AS nucleus_id FROM limits",
    "nuclei_per_image": "SELECT image, nuclei, CAST(sum(nuclei) OVER (ORDER BY image) AS BIGINT) AS total FROM (SELECT image, count(*) AS nuclei FROM limits GROUP BY image)",
    "contrast_stretch": "SELECT crop_index, y, x, CASE WHEN hi > lo THEN CAST(trunc((least(greatest(CAST(p AS DOUBLE), p2), p98) - p2) / (p98 - p2 + 1e-6::DOUBLE) * 255) AS INTEGER) ELSE 0 END AS p FROM crops JOIN levels USING (crop_index)",
    "foreground_mask": "SELECT crop_index, y, x, CASE WHEN p > lo + (hi - lo) * 0.1::DOUBLE THEN 1 ELSE 0 END AS m FROM crops JOIN levels USING (crop_index)",
    "center_paste": """SELECT image, label, z, y, x, i FROM (
  SELECT image, label, CAST(z - z0 + floor((12 - (z1 - z0)) / 2.0) AS INTEGER) AS z, CAST(y - y0 + floor((12 - (y1 - y0)) / 2.0) AS INTEGER) AS y, CAST(x - x0 + floor((12 - (x1 - x0)) / 2.0) AS INTEGER) AS x, i FROM label_voxels JOIN boxes USING (image, label))
WHERE z BETWEEN 0 AND 11 AND y BETWEEN 0 AND 11 AND x BETWEEN 0 AND 11""",
    "nn_transfer": f"""SELECT mesh_id, z, y, x, vertex_id, {r('intensity')} AS intensity FROM (
  SELECT o.mesh_id, o.z, o.y, o.x, v.vertex_id, v.intensity, row_number() OVER (PARTITION BY o.mesh_id, o.z, o.y, o.x ORDER BY
    power((o.z + 0.5::DOUBLE) / 64 - 0.5 - v.x, 2) + power((o.y + 0.5::DOUBLE) / 64 - 0.5 - v.y, 2) + power((o.x + 0.5::DOUBLE) / 64 - 0.5 - v.z, 2), v.vertex_id) AS n
  FROM occupied o JOIN vertices v ON v.mesh_id = o.mesh_id) WHERE n = 1""",
    "gaussian_blur3d": by_slice("blurred", "nucleus_id"),
    "best_slice": "SELECT nucleus_id, best_z, n FROM best",
    "train_mask": "SELECT nucleus_id, y AS r, x AS c, CASE WHEN max(mask) OVER (PARTITION BY nucleus_id) = 0 AND y = 4 AND x = 4 THEN 255 ELSE mask END AS mask, level FROM trained",
    "resize_nearest": "SELECT nucleus_id, count(*) AS pixels, CAST(sum(mask * (r + 2 * c)) AS BIGINT) AS mixed FROM trained JOIN range(65) a(r) ON y = floor((r + 0.5::DOUBLE) * 8 / 65) JOIN range(65) b(c) ON x = floor((c + 0.5::DOUBLE) * 8 / 65) GROUP BY nucleus_id",
    "resize_bicubic": "SELECT nucleus_id, count(*) AS pixels, CAST(sum(level * (r + 2 * c)) AS BIGINT) AS mixed FROM bicubic GROUP BY nucleus_id",
    "pointmap": f"SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, {r('-1 + 2.0::DOUBLE * c / 64')} AS px, {r('-1 + 2.0::DOUBLE * r / 32')} AS py, 5.0::DOUBLE AS pz FROM range(33) a(r), range(65) b(c)",
    "bce_loss": f"SELECT nucleus_id, {r('avg(loss)')} AS loss FROM losses GROUP BY nucleus_id",
    "epoch_loss": f"SELECT {r('avg(loss)')} AS loss FROM (SELECT nucleus_id // 16 AS batch, avg(loss) AS loss FROM losses GROUP BY 1)",
    "sample_collate": f"SELECT nucleus_id, CASE WHEN max(x) > 0.2::DOUBLE THEN {r('max(x)')} ELSE 1.0::DOUBLE END AS scale, 0.0::DOUBLE AS shift FROM logits GROUP BY nucleus_id",
}

SQL = {name: sql(statement) if not statement.startswith("WITH") else statement for name, statement in STATEMENTS.items()}
