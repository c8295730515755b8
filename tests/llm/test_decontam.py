import random
import re

from pyspark.sql import functions as F

from lamella.llm import decontam
from lamella.session import ship
from tests.llm.brute import LOWER


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for i, text in items:
        own = words(text)
        m = min(10, len(own))
        for k in range(len(own) - m + 1 if m else 0):
            windows.setdefault(tuple(own[k : k + m]), set()).add(i)
    out = []
    for i, text in docs:
        own, hit, found = words(text), set(), set()
        for m in {len(w) for w in windows}:
            for k in range(len(own) - m + 1):
                names = windows.get(tuple(own[k : k + m]))
                if names is not None:
                    hit |= set(range(k, k + m))
                    found |= {str(n) for n in names if n is not None}
        out.append((str(i), len(own), len(hit), sorted(found)))
    return sorted(out)


def case(rng):
    word = lambda: rng.choice(["a", "b", "c", "é1", "dd"])
    items = [(n, " ".join(word() for _ in range(rng.choice([1, 3, 9, 10, 12, 30])))) for n in range(12)]
    items += [(None, "null item text of quite ten words or so I think"), (50, None), (51, "..."), (7, "x y z"), (7, "x y z")]
    docs = [(n, rng.choice([" ", "-", "  "]).join(word() for _ in range(rng.randrange(80)))) for n in range(60)]
    docs += [(99, None), (100, ""), (None, items[0][1]), (101, "Null ITEM text, of quite ten words or so; I think! more"), (102, "x, Y z!"), (102, "x, Y z!"), (103, "q " * 100_000 + "x y z")]
    return docs, items


def test_against_brute_force(spark):
    ship(spark)
    docs, items = case(random.Random(4))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("n_hit", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string")
    spans = {}
    for block in (decontam.BLOCK_BYTES, 300):
        got = decontam.contaminated(d, b, block_bytes=block).collect()
        spans[block] = sorted((str(r.doc_id), r.n_hit, [tuple(s) for s in r.spans]) for r in got)
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"])) for r in got) == brute(docs, items)
        clean = decontam.keep_clean(d, b, block_bytes=block)
        want = sorted(i for i, _, n, _ in brute(docs, items) if not n)
        assert sorted(str(r.doc_id) for r in clean.collect()) == want and clean.columns == d.columns
        assert decontam.keep_clean(d.limit(0), b, block_bytes=block).count() == 0
    assert spans[decontam.BLOCK_BYTES] == spans[300]
    assert decontam.keep_clean(d, b.limit(0)).count() == d.count()
    assert decontam.contaminated(d.limit(0), b).count() == 0
    assert decontam.contaminated(d, b.limit(0)).where("n_hit > 0").count() == 0


def test_spans(spark):
    text = "Été: one two three four five six seven eight nine ten, été"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    (span,) = decontam.contaminated(d, b).first().spans
    assert text[span.start : span.end] == "one two three four five six seven eight nine ten"


def test_equal_hashes_are_not_equal_words(monkeypatch):
    """Even if all words had one hash, only windows of the very words would hit."""
    import numpy as np
    import pyarrow as pa

    from lamella.llm import text as X

    monkeypatch.setattr(X, "hash_spans", lambda raw, starts, ends: np.ones(len(starts), np.uint64))
    tables, _ = decontam.compile_windows([(1, "a bb c d e f g h i jj"), (2, "x y")])
    docs = ["1 2 a bb c d e f g h i jj 3", "a bb c d e f g h i kk", "a b bc d e f g h i jj", "X, y; z", "y x"]
    hit, first, items = decontam.search(*X.column_bytes(pa.array(docs)), tables)
    assert [np.flatnonzero(hit[a:z]).tolist() for a, z in zip(first[:-1], first[1:])] == [list(range(2, 12)), [], [], [0, 1], []]
    assert items == {0: {0}, 3: {1}}


def test_clean_words_are_skipped():
    """A text without any pair of words from a window is read at a fraction of its positions."""
    import numpy as np

    from lamella.llm import text as X

    rng = np.random.default_rng(1)
    windows = X.mix(rng.integers(0, 2**63, (50, 10), dtype=np.uint64))
    t = decontam.Tables(windows, [[0]] * 50)
    assert t.shift.max() == 9 and (t.shift == 9).mean() > 0.8
    doc = X.mix(rng.integers(0, 2**63, 5000, dtype=np.uint64))
    doc[1000:1010] = windows[3]
    last, which = t.find(doc, np.array([0, 5000]))
    assert last.tolist() == [1009] and (t.windows[which[0]] == windows[3]).all()
