"""Benchmark passages in documents by Wu-Manber search over words.

A window of ten words is a pattern of ten symbols. For each pattern length the
search keeps a shift table over hashed blocks of two words, which tells how far
the next possible window end is, and buckets of patterns by the hash of their
last words; what a bucket offers is compared word by word, first by hash and then
byte by byte. Most positions of a clean text are skipped, as most pairs of words
occur in no window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm import text as X
from lamella.session import bounded, cut

WINDOW = 10
#: Benchmark text compiled into one set of tables; more makes several sets, searched one after the other.
BLOCK_BYTES = 4 << 20
LANE = 256


class Tables:
    """Shift table and suffix buckets for the distinct windows of one length.

    ``words`` are bytes, and starts and ends of words in them; a window is the
    words from ``at`` on.
    """

    def __init__(self, windows: np.ndarray, owners: list[list[int]], at: np.ndarray | None = None, words: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        self.m = m = windows.shape[1]
        self.block, self.tail = min(2, m), min(4, m)
        suffix = X.hash_windows_rows(windows[:, m - self.tail :])
        order = np.argsort(suffix, kind="stable")
        self.windows, self.suffix = windows[order], suffix[order]
        self.owners = [owners[i] for i in order]
        self.at, self.words = None if at is None else at[order], words
        bits = max(12, min(22, int(len(windows) * m).bit_length() + 3))
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, m - self.block + 1, np.int64)
        for j in range(self.block, m + 1):
            at = X.hash_windows_rows(windows[:, j - self.block : j]) & self.mask
            np.minimum.at(self.shift, at.astype(np.int64), m - j)

    def find(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of last words of occurrences, and the window that occurs there."""
        m, b = self.m, self.block
        begin, end = first[:-1] + m - 1, first[1:]
        rows = np.flatnonzero(begin < end)
        if not len(rows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        many = -(-(end[rows] - begin[rows]) // LANE)
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at = np.repeat(begin[rows], many) + step * LANE
        stop = np.minimum(at + LANE, np.repeat(end[rows], many))
        halts = []
        while len(at):
            key = X.hash_windows_rows(np.stack([words[at - b + 1 + j] for j in range(b)], axis=1))
            jump = self.shift[(key & self.mask).astype(np.int64)]
            halts.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            alive = at < stop
            at, stop = at[alive], stop[alive]
        ends = np.concatenate(halts)
        if not len(ends):
            return ends, ends
        key = X.hash_windows_rows(np.stack([words[ends - self.tail + 1 + j] for j in range(self.tail)], axis=1))
        lo, hi = np.searchsorted(self.suffix, key, "left"), np.searchsorted(self.suffix, key, "right")
        count = hi - lo
        ends, lo, count = ends[count > 0], lo[count > 0], count[count > 0]
        offered = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        ends = np.repeat(ends, count)
        same = np.ones(len(ends), bool)
        for j in range(m):
            same &= words[ends - m + 1 + j] == self.windows[offered, j]
        return ends[same], offered[same]

    def confirm(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, last: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Whether the words that end at ``last`` are, byte by byte, those of the windows ``which``."""
        own, from_, to = self.words
        step = np.arange(self.m)
        a = (last[:, None] - self.m + 1 + step).ravel()
        b = (self.at[which][:, None] + step).ravel()
        return X.same_spans(raw, starts[a], ends[a], own, from_[b], to[b]).reshape(-1, self.m).all(1)


def compile_windows(items: list[tuple], window: int = WINDOW) -> tuple[list[Tables], list[str | None]]:
    """Tables by window length for (item_id, text) pairs, and the items' names."""
    names = sorted({str(i) for i, _ in items if i is not None})
    number = {n: k for k, n in enumerate(names)}
    raw, offsets = X.column_bytes(pa.array([t for _, t in items], pa.large_string()))
    low = X.LOWER[raw]
    starts, ends, first = X.find_words(low, offsets, X.BY_ALNUM)
    words = X.hash_spans(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    found: dict[int, dict[bytes, tuple[int, set[int]]]] = {}
    for row, (item, _) in enumerate(items):
        a, n = int(first[row]), int(first[row + 1] - first[row])
        m = min(window, n)
        text = [low[s:e].tobytes() for s, e in zip(starts[a : a + n].tolist(), ends[a : a + n].tolist())]
        for i in range(n - m + 1 if m else 0):
            # No word holds a blank.
            _, owners = found.setdefault(m, {}).setdefault(b" ".join(text[i : i + m]), (a + i, set()))
            if item is not None:
                owners.add(number[str(item)])
    tables = []
    for m, each in sorted(found.items()):
        at = np.array([k for k, _ in each.values()], np.int64)
        tables.append(Tables(words[at[:, None] + np.arange(m)], [sorted(v) for _, v in each.values()], at, (low, starts, ends)))
    return tables, names


def _characters(raw: np.ndarray) -> np.ndarray:
    """Number of code points before each byte, and at the end."""
    return np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])


def search(raw: np.ndarray, offsets: np.ndarray, tables: list[Tables]) -> tuple:
    """Whether each word of all rows is hit, the first word of each row, and by row the numbers of items with occurring windows."""
    low = X.LOWER[raw]
    starts, ends, first = X.find_words(low, offsets, X.BY_ALNUM)
    words = X.hash_spans(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    delta = np.zeros(len(words) + 1, np.int64)
    items: dict[int, set[int]] = {}
    for t in tables:
        last, which = t.find(words, first)
        sure = t.confirm(low, starts, ends, last, which)
        last, which = last[sure], which[sure]
        np.add.at(delta, last - t.m + 1, 1)
        np.add.at(delta, last + 1, -1)
        pairs = np.unique(np.stack([np.searchsorted(first, last, "right") - 1, which]), axis=1)
        for row, w in pairs.T.tolist():
            items.setdefault(row, set()).update(t.owners[w])
    return np.cumsum(delta)[:-1] > 0, first, items


def spans_of(raw: np.ndarray, offsets: np.ndarray, hit: np.ndarray) -> list[list[dict]]:
    """By row the stretches of words that are hit, in code points."""
    starts, ends, first = X.find_words(X.LOWER[raw], offsets, X.BY_ALNUM)
    sums = np.concatenate([[0], np.cumsum(hit)])
    out: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
    for r in np.flatnonzero(sums[first[1:]] - sums[first[:-1]]):
        a, z = offsets[r], offsets[r + 1]
        at = _characters(raw[a:z])
        own = hit[first[r] : first[r + 1]]
        turns = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
        out[r] = [{"start": int(at[starts[first[r] + s] - a]), "end": int(at[ends[first[r] + e - 1] - a])} for s, e in zip(turns[::2], turns[1::2])]
    return out


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
SCHEMA = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


def _listed(items: dict[int, set[int]], names: list[str], rows: int) -> list[list[str]]:
    return [[names[k] for k in sorted(items.get(r, ()))] for r in range(rows)]


def _searcher(shared):
    @X.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, names = shared.value
        for batch in batches:
            raw, offsets = X.column_bytes(batch.column(1))
            for i, j in X.blocks(offsets):
                own, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                hit, first, items = search(own, at, tables)
                sums = np.concatenate([[0], np.cumsum(hit)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(first)), pa.array(sums[first[1:]] - sums[first[:-1]]), pa.array(_listed(items, names, j - i), pa.list_(pa.string())), pa.array(spans_of(own, at, hit), SPAN)], ["id", "n_words", "n_hit", "items", "spans"])

    return run


def _part_searcher(shared):
    """For one block of several: positions of hit words, for rows that have any."""

    @X.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, names = shared.value
        for batch in batches:
            raw, offsets = X.column_bytes(batch.column(0))
            for i, j in X.blocks(offsets):
                hit, first, items = search(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], tables)
                places = [np.flatnonzero(hit[first[r] : first[r + 1]]) for r in range(j - i)]
                rows = [r for r in range(j - i) if len(places[r])]
                listed = _listed(items, names, j - i)
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array([i + r for r in rows], pa.int64())), pa.array([places[r] for r in rows], pa.list_(pa.int64())), pa.array([listed[r] for r in rows], pa.list_(pa.string()))], ["mark", "places", "items"])

    return run


@X.lean
def _joiner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and spans of rows from the positions that all blocks have found: columns id, text, places, items."""
    for batch in batches:
        raw, offsets = X.column_bytes(batch.column(1))
        for i, j in X.blocks(offsets):
            own, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            _, _, first = X.find_words(X.LOWER[own], at, X.BY_ALNUM)
            places = [p or [] for p in batch.column(2).slice(i, j - i).to_pylist()]
            hit = np.zeros(first[-1], bool)
            for r, p in enumerate(places):
                hit[first[r] + np.array(p, np.int64)] = True
            items = pc.coalesce(batch.column(3).slice(i, j - i), pa.scalar([], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(first)), pa.array([len(p) for p in places], pa.int64()), items, pa.array(spans_of(own, at, hit), SPAN)], ["id", "n_words", "n_hit", "items", "spans"])


def _sql_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: ``id_col``, n_words, n_hit, items, spans.

    n_hit counts words inside any occurrence of a benchmark window; items are
    the ids, as sorted strings, whose windows occur; spans are the hit stretches
    of the text in code points. An item of fewer words than ``window`` is one
    window; one without words or with null text is none. A null text has no
    words. Windows of an item without an id hit, but no item is listed for them.
    Repeated rows get equal results; null ids pass through. Empty tables give
    no rows or no hits. Other columns are ignored, whatever their names.

    The benchmark's bytes are counted first. Up to ``block_bytes`` its tables
    are one broadcast; beyond, it is dealt into blocks of that size, each is
    searched on its own, and the words that any block hits are united by text,
    so that counts and spans don't depend on the number of blocks.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).where("text is not null")
    sc = docs.sparkSession.sparkContext
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    parts = -(-size // block_bytes)
    kind = _sql_type(rows, "id")
    if parts <= 1:
        tables = compile_windows([tuple(r) for r in items.collect()], window)
        out = rows.mapInArrow(_searcher(sc.broadcast(tables)), f"id {kind}, {SCHEMA}")
        return out.withColumnRenamed("id", id_col)
    # Items are dealt singly, so that a block's size is bounded by its share and one item.
    dealt = cut(items.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(2 * parts))))
    marked = rows.select("text", F.sha2("text", 256).alias("mark")).where("text is not null")
    hits = docs.sparkSession.createDataFrame([], "mark string, places array<long>, items array<string>")
    for part in range(2 * parts):
        block = [(r["item"], r["text"]) for r in dealt.where(F.col("part") == part).collect()]
        if block:
            shared = sc.broadcast(compile_windows(block, window))
            own = cut(marked.mapInArrow(_part_searcher(shared), "mark string, places array<long>, items array<string>").dropDuplicates(["mark"]))
            shared.unpersist()
            hits = hits.unionByName(own)
    # A text's hits are bounded by its own words and the number of blocks.
    united = cut(hits.groupBy("mark").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")))
    found = rows.withColumn("mark", F.sha2("text", 256)).join(bounded(united), "mark", "left").select("id", "text", "places", "items")
    return found.mapInArrow(_joiner, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``docs``, with all their columns, that hold no window of the benchmark; without a join.

    The benchmark is dealt into blocks of ``block_bytes`` as in ``contaminated``;
    the rows that one block leaves are written and searched for the next. Rows
    with null, empty or wordless text stay, as do null ids; repeated rows stay or
    go together. Empty tables give no rows, or all.
    """
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    parts = -(-size // block_bytes)
    parts = 2 * parts if parts > 1 else 1
    at = docs.columns.index(text_col)

    def cleaned(shared):
        @X.lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables, _ = shared.value
            for batch in batches:
                raw, offsets = X.column_bytes(batch.column(at))
                for i, j in X.blocks(offsets):
                    hit, first, _ = search(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], tables)
                    sums = np.concatenate([[0], np.cumsum(hit)])
                    yield batch.slice(i, j - i).filter(pa.array(sums[first[1:]] == sums[first[:-1]]))

        return run

    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).collect()
        shared = docs.sparkSession.sparkContext.broadcast(compile_windows([tuple(r) for r in own], window))
        docs = docs.mapInArrow(cleaned(shared), docs.schema)
        if part + 1 < parts:
            docs = cut(docs)
    return docs


ORACLE = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
item_windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM item_windows),
doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::VARCHAR[]) AS w
  FROM documents),
doc_windows AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc, lengths WHERE len(w) >= m)),
hits AS (SELECT d.doc_id, d.i, d.m, x.item_id FROM doc_windows d JOIN item_windows x ON d.m = x.m AND d.win = x.win),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
