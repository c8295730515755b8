"""Fuzzy duplicate lines by MinHash over character shingles.

Every line becomes a set of character shingles with a MinHash signature; equal
lines are one class from the start. Signatures are cut into many short bands for
high recall, lines that meet in a band are verified by exact Jaccard similarity,
and distributed union-find joins the links. Lines too short for a shingle are
copies of equal lines alone; blank lines are nobody's copies. The first line of a
component, by document and place, is kept; all its others are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.llm import text as X
from lamella.llm.components import buckets, meeting, resolve
from lamella.session import bounded, cut, release

#: Code points of a shingle, bands, MinHashes of a band. At a similarity of 0.8 a pair meets with probability 0.995.
SHINGLE, BANDS, DEPTH = 8, 10, 4
#: Bytes handled at once; arrays of eight bytes each then are small enough to be reused by the allocator.
BLOCK = 1 << 17
#: Sketch words of 64 bits.
WORDS = 16
_RNG = np.random.default_rng(77)
_A = _RNG.integers(1, 2**31, BANDS * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 2**31, BANDS * DEPTH, dtype=np.uint32)


def _lines(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place, and first and last code point (exclusive) of each line without the blanks around it; the code points themselves, A-Z in lower case."""
    codes = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = (raw & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(lead)])
    bounds = before[offsets]
    breaks = np.flatnonzero(codes == 10)
    # A break at a row's very end opens one more line in that row.
    row = np.searchsorted(breaks, bounds[1:], "left") - np.searchsorted(breaks, bounds[:-1], "left") + 1
    rows = np.repeat(np.arange(len(row)), row)
    first = np.cumsum(row) - row
    place = np.arange(len(rows)) - first[rows]
    starts = np.empty(len(rows), np.int64)
    starts[first] = bounds[:-1]
    starts[place > 0] = breaks + 1
    ends = np.empty(len(rows), np.int64)
    last = np.cumsum(row) - 1
    ends[last] = bounds[1:]
    inner = np.ones(len(rows), bool)
    inner[last] = False
    ends[inner] = breaks
    return codes, rows, place, starts, ends


def _trimmed(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines without blanks at either end, and the code points in lower case."""
    blank = (codes == 32) | (codes == 9) | (codes == 13)
    solid = np.flatnonzero(~blank)
    if not len(solid):
        return codes, starts, starts
    low = np.where((codes >= 65) & (codes <= 90), codes + 32, codes).astype(np.uint32)
    a = np.searchsorted(solid, starts)
    z = np.searchsorted(solid, ends) - 1
    some = z >= a
    s = np.where(some, solid[np.minimum(a, len(solid) - 1)], starts)
    e = np.where(some, solid[np.maximum(z, 0)] + 1, starts)
    return low, s, e


def _own_lines(raw: np.ndarray, offsets: np.ndarray, least: int):
    """All lines, and which of them have ``least`` code points and aren't blank."""
    codes, rows, place, starts, ends = _lines(raw, offsets)
    low, starts, ends = _trimmed(codes, starts, ends)
    own = np.flatnonzero(ends - starts >= max(least, 1))
    return low, rows, place, starts, ends, own


def _names(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each line: two sums over its code points in order; no line is empty."""
    many = ends - starts
    bounds = np.concatenate([[0], np.cumsum(many)])
    order = np.arange(bounds[-1]) - np.repeat(bounds[:-1], many)
    step = X.mix(np.arange(int(many.max()), dtype=np.uint64) + X.U(5))
    points = low[np.repeat(starts, many) + order].astype(np.uint64) ^ step[order]
    h1, h2 = (np.add.reduceat(X.mix(points ^ X.U(salt)), bounds[:-1]) for salt in (3 << 32, 12345678901 << 21))
    return h1, h2


def _shingled(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the given lines, and bounds by line."""
    every = X.hash_runs(low, SHINGLE)
    many = ends - starts - SHINGLE + 1
    bounds = np.concatenate([[0], np.cumsum(many)])
    at = np.repeat(starts - bounds[:-1], many) + np.arange(bounds[-1])
    return every[at], bounds


def _banded(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A key of each line and band; no line is without shingles."""
    small = (values >> X.U(32)).astype(np.uint32)
    hashed = np.empty_like(small)
    out = np.empty((len(bounds) - 1, BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(bounds) - 1, b, np.uint64)
        for m in range(b * DEPTH, (b + 1) * DEPTH):
            np.multiply(small, _A[m], out=hashed)
            np.add(hashed, _B[m], out=hashed)
            key = X.mix(key * X.U(0x9E3779B97F4A7C15) + np.minimum.reduceat(hashed, bounds[:-1]))
        out[:, b] = key
    return out


@X.lean
def _signed(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw_all, offsets_all = X.column_bytes(batch.column(1))
        for i, j in X.blocks(offsets_all, BLOCK):
            raw, offsets = raw_all[offsets_all[i] : offsets_all[j]], offsets_all[i : j + 1] - offsets_all[i]
            low, rows, place, starts, ends, own = _own_lines(raw, offsets, least)
            if not len(own):
                continue
            h1, h2 = _names(low, starts[own], ends[own])
            # Lines under a shingle's length have no set, and no bands to meet others in.
            whole = ends[own] - starts[own] >= SHINGLE
            bands = _banded(*_shingled(low, starts[own][whole], ends[own][whole])) if whole.any() else np.zeros(0, np.uint64)
            dealt = np.concatenate([[0], np.cumsum(np.where(whole, BANDS, 0))])
            at = pa.array(rows[own] + i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(place[own]), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), X.long_lists(bands.ravel(), dealt)], ["id", "mark", "place", "h1", "h2", "bands"])


@X.lean
def _texts(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The lines asked for, without blanks and in lower case, with the sizes and sketches of their sets and their bands: columns id, text, places and nodes."""
    for batch in batches:
        raw_all, offsets_all = X.column_bytes(batch.column(1))
        for i, j in X.blocks(offsets_all, BLOCK):
            raw, offsets = raw_all[offsets_all[i] : offsets_all[j]], offsets_all[i : j + 1] - offsets_all[i]
            low, rows, place, starts, ends, own = _own_lines(raw, offsets, least)
            places, nodes = (batch.column(c).slice(i, j - i) for c in (2, 3))
            asked = np.repeat(np.arange(j - i), np.asarray(places.value_lengths())) << 40 | np.asarray(places.flatten())
            order = np.argsort(asked)
            code = rows[own] << 40 | place[own]
            at = np.minimum(np.searchsorted(asked[order], code), max(len(asked) - 1, 0))
            found = np.flatnonzero(asked[order][at] == code) if len(asked) else np.zeros(0, np.int64)
            if not len(found):
                continue
            node = np.asarray(nodes.flatten())[order][at[found]]
            a, z = starts[own][found], ends[own][found]
            values, bounds = _shingled(low, a, z)
            bands = _banded(values, bounds)
            items, limits = X.distinct_by_row(values, bounds)
            text = [low[s:e].tobytes().decode("utf-32-le") for s, e in zip(a.tolist(), z.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(text, pa.string()), pa.array(np.diff(limits)), *[pa.array(w.view(np.int64)) for w in X.sketches(items, limits, WORDS)], X.long_lists(bands.ravel(), np.arange(len(found) + 1) * BANDS)], ["node", "line", "size", *[f"s{w}" for w in range(WORDS)], "bands"])


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a string column, and bounds by row."""
    raw, offsets = X.column_bytes(column)
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32), before[offsets]


@X.lean
def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of lines (la, lb) whose sets of shingles are similar enough."""
    for whole in batches:
        sizes = [X.column_bytes(whole.column(c))[1] for c in (2, 3)]
        for i, j in X.blocks(sizes[0] + sizes[1]):
            batch = whole.slice(i, j - i)
            # A line's set is made once a block, of numbers from 0 for the shingles that occur in it.
            both = np.concatenate([np.asarray(batch.column(0)), np.asarray(batch.column(1))])
            _, first, number = np.unique(both, return_index=True, return_inverse=True)
            codes, bounds = _codes(pa.concat_arrays([batch.column(2), batch.column(3)]).take(pa.array(first)))
            items, at = X.distinct_by_row(*_shingled(codes, bounds[:-1], bounds[1:]))
            names, items = np.unique(items, return_inverse=True)
            size, (one, two) = np.diff(at), np.split(number, 2)
            common, mark = np.empty(batch.num_rows, np.int64), np.zeros(len(names), bool)
            order = np.argsort(two, kind="stable")
            edges = np.flatnonzero(np.diff(two[order], prepend=-1, append=-1))
            for s, e in zip(edges[:-1], edges[1:]):
                pivot, rows = two[order[s]], order[s:e]
                mark[items[at[pivot] : at[pivot + 1]]] = True
                many = size[one[rows]]
                to = np.cumsum(many) - many
                where = np.repeat(at[one[rows]] - to, many) + np.arange(many.sum())
                common[rows] = np.add.reduceat(mark[items[where]], to, dtype=np.int64)
                mark[items[at[pivot] : at[pivot + 1]]] = False
            yield batch.select([0, 1]).filter(pa.array(100 * common >= percent * (size[one] + size[two] - common)))


def _similar_lines(pairs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """Pairs are joined with the lines themselves, which are far smaller than their sets; only lines of a pair are moved."""
    own = lines.join(bounded(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "node", "left_semi")
    left, right = (own.select(F.col("node").alias(x), F.col("line").alias(f"l{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "la", "lb")
    return both.mapInArrow(partial(_verified, percent=percent), "a long, b long")


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents by id and a mark of their text, as one id may come with several texts."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, least: int = 1) -> DataFrame:
    """Lines to drop: (id, mark, places), places being numbers of lines from 0, for documents that have any; mark is the text's hash.

    Lines are split at newlines and compared without blanks around them and
    with A-Z in lower case; blank ones, and those of fewer than ``least`` code
    points, are left alone. Two lines are linked if they are equal or the
    Jaccard similarity of their character shingles is ``percent`` / 100 at
    least; lines of fewer than 8 code points have no shingle and link with
    equal ones only. Of each component the line with the smallest id, mark and
    place is kept.

    A null or empty text has no line to drop. Rows that repeat id and text are
    one document, whose lines stay or go together. Rows without an id are left
    as they are and drop nothing. An empty table gives an empty result. Other
    columns are ignored, whatever their names.
    """
    kind = docs.schema[id_col].dataType
    rows = _marked(docs, id_col, text_col).where("id is not null and text is not null")
    long_, longs = T.LongType(), T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("id", kind), *[T.StructField(c, long_) for c in ("mark", "place", "h1", "h2")], T.StructField("bands", longs)])
    signed = cut(rows.select("id", "text", "mark").mapInArrow(partial(_signed, least=least), schema))

    # Equal lines are a class, named by a number; (id, mark, place) orders its lines.
    here = ["id", "mark", "place"]
    equal = signed.groupBy("h1", "h2").agg(F.min(F.struct(*here)).alias("first"), F.count("*").alias("lines"))
    classes = cut(equal.withColumn("node", F.monotonically_increasing_id()))
    release(docs.sparkSession)
    # Only names are dealt to all bands; the rest joins those that meet another class.
    dealt = signed.select("h1", "h2", F.posexplode("bands").alias("at", "key")).withColumn("who", F.xxhash64("h1", "h2"))
    met = meeting(dealt.select("key", "at", "h1", "h2", "who"), "who").drop("who")
    met = cut(met.join(classes.select("h1", "h2", "node"), ["h1", "h2"]).select("key", "at", "node"), few=True)

    asked = classes.join(bounded(met.select("node").distinct()), "node").select("first.*", "node")
    asked = cut(asked.groupBy("id", "mark").agg(F.collect_list("place").alias("places"), F.collect_list("node").alias("nodes")))
    texts = rows.join(bounded(asked), ["id", "mark"]).select("id", "text", "places", "nodes")
    sketch = [f"s{w}" for w in range(WORDS)]
    # Rows that repeat an id and text give a line more than once, of which one is enough.
    known = cut(texts.mapInArrow(partial(_texts, least=least), f"node long, line string, size long, {', '.join(f'{w} long' for w in sketch)}, bands array<long>").dropDuplicates(["node"]))
    release(docs.sparkSession)
    work = buckets(met, known.select("node", F.struct("size", *sketch, "bands").alias("about")))

    def first_meeting(a: Column, b: Column) -> Column:
        return F.array_position(F.zip_with(a["bands"], b["bands"], lambda x, y: x == y), True) - 1 == a["at"]

    roots = resolve(work, percent, lambda pairs: _similar_lines(pairs, known.select("node", "line"), percent), WORDS, first_meeting)

    # Only classes of several lines, or linked with others, have lines to drop.
    many = classes.where("lines > 1").select("h1", "h2", "first")
    if roots is not None:
        linked = classes.join(bounded(roots), "node").select("h1", "h2", "first", "root")
        best = cut(linked.groupBy("root").agg(F.min("first").alias("best")), few=True)
        joined = cut(linked.join(bounded(best), "root").select("h1", "h2", F.col("best").alias("first")))
        many = cut(joined.unionByName(many.join(bounded(joined.select("h1", "h2")), ["h1", "h2"], "left_anti")))
    gone = signed.select(*here, "h1", "h2").join(bounded(many), ["h1", "h2"]).where(F.struct(*here) != F.col("first"))
    return gone.groupBy("id", "mark").agg(F.collect_set("place").alias("places"))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, least: int = 1) -> DataFrame:
    """One row per document: ``id_col``, n_lines (a null text has one, empty), n_dropped, dropped (places, ascending)."""
    gone = cut(duplicate_lines(docs, id_col, text_col, percent, least))
    breaks = F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))), F.lit(0))
    rows = _marked(docs, id_col, text_col).select("id", "mark", (breaks + 1).cast("long").alias("n_lines"))
    places = F.coalesce(F.array_sort("places"), F.array().cast("array<bigint>"))
    return rows.join(gone, ["id", "mark"], "left").select(F.col("id").alias(id_col), "n_lines", F.size(places).cast("long").alias("n_dropped"), places.alias("dropped"))


@X.lean
def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, places = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out = [t if t is None or not p else "\n".join(line for n, line in enumerate(t.split("\n")) if n not in gone) for t, p in zip(texts, places) for gone in [set(p or ())]]
        yield pa.RecordBatch.from_arrays([pa.array(out, batch.column(0).type), *batch.columns[2:]], ["__text", *batch.schema.names[2:]])


def drop_lines(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all their columns, the text without the lines in ``gone`` (id, mark, places)."""
    gone = gone.select(F.col("id").alias("__id"), F.col("mark").alias("__mark"), F.col("places").alias("__places"))
    same = (F.col(id_col) == F.col("__id")) & (F.xxhash64(text_col) == F.col("__mark"))
    joined = docs.join(bounded(gone), same, "left")
    others = [c for c in docs.columns if c != text_col]
    schema = T.StructType([T.StructField("__text", T.StringType()), *[docs.schema[c] for c in others]])
    out = joined.select(F.col(text_col), "__places", *others).mapInArrow(_rebuilt, schema)
    return out.withColumnRenamed("__text", text_col).select(*docs.columns)


#: Exact: two sets of similarity 0.8 share one of the rarest shingles of either, as many as a fifth of its size and one.
ORACLE = r"""
WITH RECURSIVE split AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
placed AS (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS place FROM split),
lines AS (SELECT doc_id, place, translate(trim(line, ' ' || chr(9) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line FROM placed),
classes AS (SELECT line, row_number() OVER (ORDER BY first) AS c FROM (SELECT line, min((doc_id, place)) AS first FROM lines WHERE line <> '' GROUP BY line)),
shingles AS (SELECT DISTINCT c, substr(line, CAST(i AS BIGINT), 8) AS s FROM (SELECT c, line, unnest(range(1, length(line) - 6)) AS i FROM classes WHERE length(line) >= 8)),
ranked AS (SELECT c, s, count(*) OVER (PARTITION BY c) AS n, row_number() OVER (PARTITION BY c ORDER BY f, s) AS p FROM shingles JOIN (SELECT s, count(*) AS f FROM shingles GROUP BY s) USING (s)),
starts AS (SELECT c, s, n FROM ranked WHERE p <= n - ceil(n * 0.8) + 1),
maybe AS (SELECT DISTINCT x.c AS a, y.c AS b, x.n AS na, y.n AS nb FROM starts x JOIN starts y ON x.s = y.s AND x.c < y.c AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
common AS (SELECT a, b, na, nb, count(*) AS k FROM maybe JOIN shingles x ON x.c = a JOIN shingles y ON y.c = b AND y.s = x.s GROUP BY a, b, na, nb),
steps AS (SELECT a, b FROM common WHERE 100 * k >= 80 * (na + nb - k)),
both_ways AS (SELECT a, b FROM steps UNION ALL SELECT b, a FROM steps),
reached AS (SELECT c, c AS other FROM classes UNION SELECT reached.c, both_ways.b FROM reached JOIN both_ways ON both_ways.a = reached.other),
roots AS (SELECT c, min(other) AS root FROM reached GROUP BY c),
first AS (SELECT root, min((doc_id, place)) AS kept FROM lines JOIN classes USING (line) JOIN roots USING (c) GROUP BY root),
gone AS (SELECT doc_id, count(*) AS n, string_agg(CAST(place AS VARCHAR), ',' ORDER BY place) AS places FROM lines JOIN classes USING (line) JOIN roots USING (c) JOIN first USING (root) WHERE (doc_id, place) <> kept GROUP BY doc_id)
SELECT doc_id, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 AS n_lines, coalesce(n, 0) AS n_dropped, coalesce(places, '') AS dropped
FROM documents LEFT JOIN gone USING (doc_id)
"""
