"""Near-duplicate documents by MinHash with tensored banding.

A table key is a pair out of two small collections of sub-keys: with eight
sub-keys of three MinHashes on either side, 48 MinHashes give 64 tables of six
MinHashes each, where separate tables would need 384. Two documents meet in a
table if they agree in a sub-key of either side; at a similarity of 0.85 that
happens with probability 0.999, at 0.8 with 0.994, per pair. Every candidate is
verified on its full shingle set.
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

SIDE, DEPTH = 8, 3
#: Sketch words of 64 bits.
WORDS = 32


@X.lean
def _signed(batches: Iterator[pa.RecordBatch], k: int, side: int, depth: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = X.column_bytes(batch.column(1))
        for i, j in X.blocks(offsets):
            values, bounds = X.distinct_by_row(*X.shingles(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k))
            one, two = X.set_ids(values, bounds)
            mins = X.min_hashes(values, bounds, 2 * side * depth)
            keys = [mins[depth * s] for s in range(2 * side)]
            for s in range(2 * side):
                for d in range(1, depth):
                    keys[s] = X.mix(keys[s] + X.U(d)) ^ mins[depth * s + d]
            sub = np.stack([X.mix(x + X.U(s)) for s, x in enumerate(keys)], axis=1)
            bounds_of = np.arange(0, (j - i) * side + 1, side)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(np.diff(bounds)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), *[pa.array(w.view(np.int64)) for w in X.sketches(values, bounds, WORDS)], X.long_lists(np.ascontiguousarray(sub[:, :side]).ravel(), bounds_of), X.long_lists(np.ascontiguousarray(sub[:, side:]).ravel(), bounds_of)],
                ["id", "mark", "n_shingles", "h1", "h2", *[f"s{w}" for w in range(WORDS)], "left", "right"],
            )


@X.lean
def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = X.column_bytes(batch.column(1))
        for i, j in X.blocks(offsets):
            values, bounds = X.distinct_by_row(*X.shingles(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), X.long_lists(values, bounds)], ["node", "items"])


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union of their sets (node, items); only sets of a pair are moved."""
    sets = sets.join(bounded(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "node", "left_semi")
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("ia"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("ib"))
    common = F.size(F.array_intersect("ia", "ib"))
    total = F.size("ia") + F.size("ib")
    fits = 100 * F.least(F.size("ia"), F.size("ib")) >= percent * F.greatest(F.size("ia"), F.size("ib"))
    return pairs.join(left, "a").join(right, "b").where(fits).withColumn("common", common).where(100 * F.col("common") >= percent * (total - F.col("common"))).select("a", "b")


def _grouped(docs: DataFrame, id_col: str, text_col: str, percent: int, k: int, side: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, mark, n_shingles, h1, h2) of all documents, mark being a hash of the text, and their sets (h1, h2, first).

    first is the least of the rows that a set's component has, as a struct of
    anonymous (whether there is no id), id and mark.
    """
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    long_, longs = T.LongType(), T.ArrayType(T.LongType())
    sketch = [f"s{w}" for w in range(WORDS)]
    schema = T.StructType([T.StructField("id", kind), *[T.StructField(c, long_) for c in ("mark", "n_shingles", "h1", "h2", *sketch)], T.StructField("left", longs), T.StructField("right", longs)])
    signed = cut(rows.mapInArrow(partial(_signed, k=k, side=side, depth=depth), schema))

    # Equal sets are one class, which is a node; first is one of its rows.
    about = F.struct(F.col("n_shingles").alias("size"), *sketch, "left", "right")
    equal = signed.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min(F.struct(F.isnull("id").alias("anonymous"), "id", "mark")).alias("first"), F.first(about).alias("about"))
    classes = cut(equal.withColumn("node", F.monotonically_increasing_id()))
    release(docs.sparkSession)
    crossed = F.flatten(F.transform("about.left", lambda x, i: F.transform("about.right", lambda y, j: F.xxhash64(x, y, i, j))))
    # Only names are dealt to all tables; sizes, sketches and sub-keys join those that meet another.
    met = meeting(classes.select("node", F.posexplode(crossed).alias("at", "key")))
    heads = cut(classes.join(bounded(met.select("node").distinct()), "node", "left_semi").select("node", "first.mark", "about"), few=True)
    work = buckets(met, heads.select("node", "about"))

    # The sets of those that meet another anywhere; a text of each class is enough.
    texts = rows.select("text", "mark").join(bounded(heads.select("node", "mark")), "mark").dropDuplicates(["node"]).select("node", "text")
    sets = cut(texts.mapInArrow(partial(_sets, k=k), "node long, items array<long>"))

    def first_meeting(a: Column, b: Column) -> Column:
        """Whether this table is the first in which the two meet, by left and then by right sub-key."""
        same = lambda part: F.array_position(F.zip_with(a[part], b[part], lambda x, y: x == y), True) - 1
        return same("left") * side + same("right") == a["at"]

    roots = resolve(work, percent, lambda pairs: similar(pairs, sets, percent), WORDS, first_meeting)

    named = classes.select("h1", "h2", "first")
    if roots is not None:
        linked = classes.select("h1", "h2", "first", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = cut(linked.groupBy("root").agg(F.min("first").alias("least")))
        named = cut(linked.join(bounded(least), "root").select("h1", "h2", F.col("least").alias("first")))
    return signed.select("id", "mark", "n_shingles", "h1", "h2"), named


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, k: int = 5, side: int = SIDE, depth: int = DEPTH) -> DataFrame:
    """Components of documents whose sets of k-word shingles have a Jaccard similarity of ``percent`` / 100 at least.

    Returns one row per input row: ``id_col``, n_shingles, component_id (smallest
    id reachable over links, itself included), kept (id = component_id).

    What is linked are sets, not ids: rows that repeat an id with other texts
    each belong where their text does, and rows that repeat id and text get
    equal results. A null or wordless text has an empty set and links with
    nothing. A row without an id takes part as all others; it is kept only if no
    row of its component has an id, and component_id is null then. An empty
    table gives an empty result. Other columns are ignored, whatever their names.
    """
    rows, named = _grouped(docs, id_col, text_col, percent, k, side, depth)
    out = rows.join(named, ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("first.id")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.col("component_id").isNull()))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, k: int = 5, side: int = SIDE, depth: int = DEPTH) -> DataFrame:
    """Rows of ``docs``, with all their columns, without near duplicates: of each component the row with the smallest id stays.

    Of rows that share the smallest id, the one with the smallest hash of its
    text stays. Rows without an id come after all others. Rows that repeat id
    and text are one document and stay or go together. Rows with null, empty or
    wordless text stay. An empty table stays empty.
    """
    rows, named = _grouped(docs, id_col, text_col, percent, k, side, depth)
    other = F.struct(F.isnull("id").alias("anonymous"), "id", "mark") != F.col("first")
    gone = cut(rows.join(named, ["h1", "h2"]).where(other).select(F.col("id").alias("__id"), F.col("mark").alias("__mark")).distinct())
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__mark"))
    return docs.join(bounded(gone), same, "left_anti")


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
steps AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reached.doc_id, steps.b FROM reached JOIN steps ON steps.a = reached.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT words.doc_id, coalesce(n, 0) AS n_shingles, component_id, words.doc_id = component_id AS kept
FROM words LEFT JOIN sizes USING (doc_id) JOIN least USING (doc_id)
"""
