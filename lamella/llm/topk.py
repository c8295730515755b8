"""Exact top-k search by inner product: ball-tree branch and bound per shard.

Candidates are dealt into shards by region: the upper levels of a tree of
halfspaces, grown on a sample of fixed size, say which cell a vector is in, and
a crowded cell is several shards. Each shard is one row that holds its vectors
in the order of a ball tree with centres and radii; the queries are dealt into
blocks in the same way. A query starts with a floor, the kth score within the
sample. A block meets only the shards whose root ball can beat the floor of one
of its queries, before any vector of a shard moves; these are searched in the
order of their bounds, in cells of a block and a group of shards, where a
query's kth score so far prunes the nodes of the next shard. Nodes are visited
by their upper bound, the inner product with the centre plus the radius times
the query's norm. All joins are equi-joins; no task holds more than a block of
queries and one shard at a time.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.session import bounded, cut

K, SCALE = 20, 64
SHARD_ROWS, QUERY_ROWS, LEAF, SAMPLE = 8192, 256, 256, 4096
#: Cells that the sample tells apart, vector lengths that get a sample, at most.
CELLS, LENGTHS = 256, 8
#: Shards that one task searches one after the other, and whose roots a block meets at once.
GROUP, ROOTS = 256, 1024
#: Integers up to here are exact as doubles.
EXACT = 2**53


def _ball_tree(vectors: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """An order of the rows, and nodes (from, to, left, right) over it, parents first; leaves have -1."""
    order = np.arange(len(vectors))
    nodes: list[tuple[int, int, int, int]] = []

    def grow(a: int, z: int) -> int:
        at = len(nodes)
        nodes.append((a, z, -1, -1))
        if z - a > LEAF:
            own = vectors[order[a:z]]
            far = own[np.argmax(((own - own[0]) ** 2).sum(1))]
            other = own[np.argmax(((own - far) ** 2).sum(1))]
            side = np.argsort(own @ (other - far), kind="stable")
            order[a:z] = order[a:z][side]
            middle = (a + z) // 2
            left, right = grow(a, middle), grow(middle, z)
            nodes[at] = (a, z, left, right)
        return at

    if len(vectors):
        grow(0, len(vectors))
    return order, nodes


def _balls(vectors: np.ndarray, nodes: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Centres and radii of nodes over rows in tree order."""
    centres = np.array([vectors[a:z].mean(0) for a, z, _, _ in nodes]).reshape(len(nodes), vectors.shape[1])
    with np.errstate(over="ignore", invalid="ignore"):
        radii = np.array([np.sqrt(((vectors[a:z] - c) ** 2).sum(1).max()) for (a, z, _, _), c in zip(nodes, centres)])
    return centres, np.nan_to_num(radii, nan=np.inf, posinf=np.inf)


class Regions:
    """Cells of space: a tree of halfspaces that cut a sample in halves. (normal, limit, left, right) by node; leaves are cells."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.nodes: list[tuple[np.ndarray, float, int, int] | int] = []
        self.cells = 0

        def grow(own: np.ndarray, cells: int) -> int:
            at = len(self.nodes)
            self.nodes.append(0)
            if cells > 1 and len(own) > 1:
                far = own[np.argmax(((own - own[0]) ** 2).sum(1))]
                normal = own[np.argmax(((own - far) ** 2).sum(1))] - far
                along = own @ normal
                limit = float(np.median(along))
                low = along < limit
                if low.any():
                    self.nodes[at] = (normal, limit, grow(own[low], cells // 2), grow(own[~low], cells - cells // 2))
                    return at
            self.nodes[at] = self.cells
            self.cells += 1
            return at

        with np.errstate(over="ignore", invalid="ignore"):
            grow(sample, cells)

    def cell(self, vectors: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(vectors), np.int64), [(0, np.arange(len(vectors)))]
        while todo:
            at, rows = todo.pop()
            node = self.nodes[at]
            if isinstance(node, int):
                out[rows] = node
            elif len(rows):
                normal, limit, left, right = node
                with np.errstate(over="ignore", invalid="ignore"):
                    low = vectors[rows] @ normal < limit
                todo += [(left, rows[low]), (right, rows[~low])]
        return out


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products; beyond a long they stay at its bounds."""
    q, v = np.abs(queries).max(initial=0), np.abs(vectors).max(initial=0)
    if float(q) * float(v) * max(1, queries.shape[1]) < EXACT:
        return (queries @ vectors.T).astype(np.int64)
    whole = np.array([[int(x) for x in row] for row in queries], object).reshape(queries.shape) @ np.array([[int(x) for x in row] for row in vectors], object).reshape(vectors.shape).T
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


class Best:
    """The k best (score, id) of each query of a block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.norms = np.sqrt((vectors**2).sum(1))
        n = len(ids)
        self.score = np.full((n, k), -(2**63), np.int64)
        self.found = np.full((n, k), -1, np.int64)
        self.count = np.zeros(n, np.int64)
        self.floor = np.full(n, -np.inf)

    def kth(self) -> np.ndarray:
        """A score that no vector below it can get into the result."""
        own = np.where(self.count >= self.k, self.score[:, -1].astype(float), -np.inf)
        return np.maximum(own, self.floor)

    def bounds(self, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
        """Scores that no vector in a ball exceeds, by query and ball; rounding of doubles is far below the slack."""
        with np.errstate(over="ignore", invalid="ignore"):
            bound = self.vectors @ centres.T + self.norms[:, None] * radii[None, :]
            bound += 1e-9 * (np.abs(bound) + self.norms[:, None] * (radii + np.sqrt((centres**2).sum(1)))[None, :]) + 1e-6
        return np.nan_to_num(bound, nan=np.inf, posinf=np.inf, neginf=-np.inf)

    def offer(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Candidates for the queries ``rows``, scores as (rows, ids)."""
        own = self.ids[rows][:, None] != ids[None, :]
        score = np.concatenate([self.score[rows], scores], axis=1)
        names = np.concatenate([self.found[rows], np.broadcast_to(ids, scores.shape)], axis=1)
        there = np.concatenate([np.arange(self.k)[None, :] < self.count[rows][:, None], own], axis=1)
        order = np.lexsort((names, -score.astype(float) if np.abs(score[there]).max(initial=0) < EXACT else ~score, ~there), axis=1)[:, : self.k]
        self.score[rows], self.found[rows] = np.take_along_axis(score, order, 1), np.take_along_axis(names, order, 1)
        self.count[rows] = np.minimum(self.k, there.sum(1))

    def search(self, ids: np.ndarray, vectors: np.ndarray, nodes: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> None:
        if not len(ids):
            return
        bound = self.bounds(centres, radii)
        heap = [(-bound[:, 0].max(), 0)]
        while heap:
            _, at = heapq.heappop(heap)
            rows = np.flatnonzero(bound[:, at] >= self.kth())
            if not len(rows):
                continue
            a, z, left, right = nodes[at]
            if left < 0:
                scores = _scores(self.vectors[rows], vectors[a:z])
                able = (scores >= self.kth()[rows][:, None]).any(1)
                if able.any():
                    self.offer(rows[able], ids[a:z], scores[able])
            else:
                for child in (left, right):
                    bound[:, child] = np.minimum(bound[:, child], bound[:, at])
                    heapq.heappush(heap, (-bound[rows, child].max(), child))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if len(column) else pa.array([], pa.float64())
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(column), dim)


def _build(key: tuple, group: pa.Table) -> pa.Table:
    """One shard's row: its root ball, and ids and vectors in tree order, nodes, centres and radii."""
    dim = key[0].as_py()
    ids = group.column("vec_id").combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
    vectors = _vectors(group.column("v").combine_chunks(), dim)
    first = np.argsort(ids, kind="stable")
    ids, vectors = ids[first], vectors[first]
    order, nodes = _ball_tree(vectors)
    ids, vectors = ids[order], vectors[order]
    centres, radii = _balls(vectors, nodes)
    pack = [ids.astype("<i8"), vectors.astype("<f4") if np.array_equal(vectors.astype("<f4"), vectors) else vectors.astype("<f8"), np.array(nodes, "<i8").reshape(-1, 4), centres.astype("<f8"), radii.astype("<f8")]
    root = np.append(centres[0], radii[0]).astype("<f8").tobytes()
    return pa.table({"dim": pa.array([dim], pa.int32()), "shard": group.column("shard").slice(0, 1), "rows": pa.array([len(ids)], pa.int64()), "root": pa.array([root], pa.binary()), "body": pa.array([b"".join(p.tobytes() for p in pack)], pa.binary()), "narrow": pa.array([pack[1].dtype.itemsize == 4])})


def _unpack(body: bytes, rows: int, dim: int, narrow: bool) -> tuple:
    kind = "<f4" if narrow else "<f8"
    at = rows * 8
    ids = np.frombuffer(body, "<i8", rows)
    vectors = np.frombuffer(body, kind, rows * dim, at).reshape(rows, dim).astype(np.float64)
    at += vectors.size * np.dtype(kind).itemsize
    n = (len(body) - at) // (32 + 8 * dim + 8)
    nodes = np.frombuffer(body, "<i8", 4 * n, at).reshape(n, 4)
    centres = np.frombuffer(body, "<f8", n * dim, at + 32 * n).reshape(n, dim)
    radii = np.frombuffer(body, "<f8", n, at + 32 * n + 8 * dim * n)
    return ids, vectors, nodes, centres, radii


def _placed(regions):
    """Adds the cell of each vector: columns vec_id, v, dim."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(2))
            cell = np.zeros(len(dims), np.int64)
            for dim in np.unique(dims):
                if dim in regions.value:
                    (rows,) = np.nonzero(dims == dim)
                    cell[rows] = regions.value[dim].cell(_vectors(batch.column(1).take(pa.array(rows)), int(dim)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["vec_id", "v", "dim", "cell"])

    return run


def _floored(samples, k: int):
    """Adds to each block the least score that a result of its queries can have: any k candidates bound the kth from below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, vectors, *_ = _unpack(row["body"], row["rows"], row["dim"], row["narrow"])
                best = Best(ids, vectors, k)
                if row["dim"] in samples.value:
                    best.search(*samples.value[row["dim"]])
                row["floor"] = best.kth().astype("<f8").tobytes()
                yield pa.RecordBatch.from_pylist([row], pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("rows", pa.int64()), ("body", pa.binary()), ("narrow", pa.bool_()), ("floor", pa.binary())]))

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For a block and a chunk of root balls the shards that can matter, best bound first, in groups: (dim, block, group, place, shard)."""
    for batch in batches:
        for row in batch.to_pylist():
            ids, vectors, *_ = _unpack(row["body"], row["rows"], row["dim"], row["narrow"])
            best = Best(ids, vectors, 1)
            roots = np.array([np.frombuffer(r["root"], "<f8") for r in row["roots"]])
            bound = best.bounds(roots[:, :-1], roots[:, -1])
            able = (bound >= np.frombuffer(row["floor"], "<f8")[:, None]).any(0)
            top = np.where(able, bound.max(0), -np.inf)
            order = [n for n in np.argsort(-top, kind="stable").tolist() if able[n]]
            n = len(order)
            group = row["chunk"] * (ROOTS // GROUP + 1) + np.arange(n) // GROUP
            yield pa.RecordBatch.from_arrays([pa.array([row["dim"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int64()), pa.array(group, pa.int64()), pa.array(np.arange(n), pa.int64()), pa.array([row["roots"][i]["shard"] for i in order], pa.int64())], ["dim", "block", "group", "place", "shard"])


def _search_cells(k: int):
    """Rows arrive sorted by cell, the block of queries first and then its shards."""

    def answer(best: Best) -> pa.RecordBatch:
        took = np.arange(k)[None, :] < best.count[:, None]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(best.ids, best.count)), pa.array(best.found[took]), pa.array(best.score[took])], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, now = None, None
        for batch in batches:
            for row in batch.to_pylist():
                cell = (row["dim"], row["block"], row["group"])
                if cell != now:
                    if best is not None:
                        yield answer(best)
                    best, now = None, cell
                part = _unpack(row["body"], row["rows"], row["dim"], row["narrow"])
                if row["place"] < 0:
                    best = Best(part[0], part[1], k)
                    best.floor = np.frombuffer(row["floor"], "<f8").copy()
                elif best is not None:
                    best.search(*part)
        if best is not None:
            yield answer(best)

    return run


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = K, scale: int = SCALE) -> DataFrame:
    """For each row whose id is divisible by ``every``: its ``k`` best among all other rows.

    Components become floor(``scale`` * x); the score is their integer inner
    product, ties go to the smaller id. Returns query_id, rank, vec_id, score.

    A null vector, one with a null, NaN or infinite component and a row without
    an id take no part. An id names one vector: of rows that repeat an id the
    least vector counts. Vectors of different lengths don't meet; those of
    length 0 score 0 with each other. Scores beyond a long stay at its bounds.
    Fewer than ``k`` candidates are all returned; an empty table gives an empty
    result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    vector = F.col(vector_col)
    valid = vector.isNotNull() & F.col(id_col).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(valid).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector, lambda x: x.cast("double")).alias("x"))
    # Doubles from 2**46 on are whole in 64ths already.
    floored = F.transform("x", lambda x: F.when(F.abs(x) < 2.0**46, F.floor(x * F.lit(float(scale))).cast("double")).otherwise(F.greatest(F.least(x * F.lit(float(scale)), F.lit(1.7e308)), F.lit(-1.7e308))))
    rows = cut(rows.groupBy("vec_id").agg(F.min("x").alias("x")).select("vec_id", floored.alias("v")))
    total = rows.count()
    rows = rows.select("vec_id", "v", F.size("v").alias("dim"))

    # One sample of SAMPLE rows for all lengths; the commonest lengths get cells and floors from it.
    share = min(1.0, SAMPLE / max(1, total))
    few = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(1_000_000)) < int(share * 1_000_000)).limit(SAMPLE).select("vec_id", "v").collect()
    by_dim: dict[int, list] = {}
    for r in few:
        by_dim.setdefault(len(r["v"]), []).append(r)
    samples, regions = {}, {}
    for d, own in sorted(by_dim.items(), key=lambda x: (-len(x[1]), x[0]))[:LENGTHS]:
        v = np.array([r["v"] for r in own], float).reshape(len(own), d)
        regions[d] = Regions(v, min(CELLS, -(-total // SHARD_ROWS)))
        order, nodes = _ball_tree(v)
        v, ids = v[order], np.array([r["vec_id"] for r in own], np.int64)[order]
        samples[d] = (ids, v, np.array(nodes).reshape(-1, 4), *_balls(v, nodes))
    sc = spark.sparkContext
    placed = cut(rows.mapInArrow(_placed(sc.broadcast(regions)), "vec_id long, v array<double>, dim int, cell long"))

    def built(own: DataFrame, most: int, salt: int) -> DataFrame:
        """Vectors by cell, a crowded one in as many parts as it needs; a part is a row."""
        parts = own.groupBy("dim", "cell").count().select("dim", "cell", F.ceil(F.col("count") / most).alias("parts"))
        part = F.col("cell") * 2**32 + F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col("parts"))
        dealt = own.join(bounded(cut(parts)), ["dim", "cell"]).select("dim", part.alias("shard"), "vec_id", "v")
        return dealt.groupBy("dim", "shard").applyInArrow(_build, "dim int, shard long, rows long, root binary, body binary, narrow boolean")

    tree = cut(built(placed, SHARD_ROWS, 0))
    asked = built(placed.where(F.col("vec_id") % every == 0), QUERY_ROWS, 1).select("dim", F.col("shard").alias("block"), "rows", "body", "narrow")
    query = cut(asked.mapInArrow(_floored(sc.broadcast(samples), k), "dim int, block long, rows long, body binary, narrow boolean, floor binary"))

    # Blocks meet root balls first, a chunk of them at once, and then the shards that these don't rule out.
    chunks = max(1, -(-tree.count() // ROOTS))
    roots = tree.withColumn("chunk", F.pmod(F.xxhash64("shard"), F.lit(chunks)).cast("int")).groupBy("dim", "chunk").agg(F.collect_list(F.struct("shard", "root")).alias("roots"))
    lists = cut(query.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).join(roots, ["dim", "chunk"]).mapInArrow(_met, "dim int, block long, group long, place long, shard long"))
    body = lists.join(tree, ["dim", "shard"]).select("dim", "block", "group", "place", "rows", "body", "narrow", F.lit(None).cast("binary").alias("floor"))
    heads = lists.select("dim", "block", "group").distinct().join(query, ["dim", "block"]).select("dim", "block", "group", F.lit(-1).cast("long").alias("place"), "rows", "body", "narrow", "floor")
    cells = body.unionByName(heads).repartition("dim", "block", "group").sortWithinPartitions("dim", "block", "group", "place")
    found = cells.mapInArrow(_search_cells(k), "query_id long, vec_id long, score long")
    # The best of each group of shards that a query's block has met: at most k rows of each.
    ranked = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score").cast("decimal(20,0)")).alias("less"), "vec_id", "score"))), 1, k).alias("best"))
    return ranked.select("query_id", F.posexplode("best").alias("at", "hit")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
