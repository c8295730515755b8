import random

import numpy as np
from pyspark.sql import functions as F

from lamella.llm import lines
from lamella.llm import queries as Q
from lamella.session import cut, ship
from tests.conftest import SF
from tests.llm.brute import groups, line_set


def brute(rows, percent=80, least=1):
    """Dropped places by id; ids are whole numbers without repeats."""
    first, sets, where = {}, {}, []
    for i, text in sorted(rows):
        for place, line in enumerate((text or "").split("\n") if text is not None else []):
            name, items = line_set(line)
            if len(name) >= least:
                first.setdefault(name, (i, place))
                sets[first[name]] = items
                where.append((i, place, name))
    root = groups(sets, percent)
    gone = {}
    for i, place, name in where:
        if root[first[name]] != (i, place):
            gone.setdefault(i, []).append(place)
    return gone


def test_query(spark):
    ship(spark)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(rows)
    got = {r.doc_id: r for r in Q.op3_linededup(spark, SF).collect()}
    assert len(got) == len(rows)
    wrong = [i for i, t in rows if got[i].dropped != ",".join(map(str, want.get(i, []))) or got[i].n_lines != len((t or "").split("\n")) or got[i].n_dropped != len(want.get(i, []))]
    # Bands miss a pair at the very threshold with probability 0.005; here none is missed.
    assert not wrong


def test_common_line_and_near_lines(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = " ".join(word() for _ in range(20))
    rows = []
    for i in range(200):
        near = base[: rng.randrange(100)] + rng.choice("xyz") + base[rng.randrange(100, 104) :]
        rows.append((i, "\n".join(["  The very SAME line stands here, and here. ", near, " ".join(word() for _ in range(15)), "short"])))
    want = brute(rows)
    gone = lines.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.id: sorted(r.places) for r in gone.collect()}
    assert sum(got.get(i) != want.get(i) for i, _ in rows) == 0
    kept = [t for i, t in rows]
    out = lines.drop_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumn("places", F.lit(7)), cut(gone))
    texts = {r.doc_id: r.text for r in out.collect()}
    for i, text in rows:
        assert texts[i] == "\n".join(x for n, x in enumerate(text.split("\n")) if n not in got.get(i, []))
    assert len(texts) == len(kept) and out.columns == ["doc_id", "text", "places"]


def test_odd_rows(spark):
    line = "a line that is long enough to count"
    rows = [(1, None), (2, ""), (3, "\n\n"), (5, line + "\n"), (4, line), (4, line), (None, line + "\n" + line), (6, "x" * 200_000), (7, ("y" * 30 + "\n") * 500), (8, "é" * 23), (9, "é" * 24 + "\n" + "É" * 24), (5, "another text under five, " + line[::-1] + "\n" + line)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("mark", F.lit(1))
    got = sorted((str(r.doc_id), r.n_lines, tuple(r.dropped)) for r in lines.line_report(df).collect())
    want = [("1", 1, ()), ("2", 1, ()), ("3", 3, ()), ("5", 2, (0,)), ("4", 1, ()), ("4", 1, ()), ("None", 2, ()), ("6", 1, ()), ("7", 501, tuple(range(1, 500))), ("8", 1, ()), ("9", 2, (0,)), ("5", 2, (1,))]
    assert got == sorted(want)
    assert lines.line_report(df.limit(0)).count() == 0
    texts = sorted((str(r.doc_id), r.text) for r in lines.drop_lines(df, lines.duplicate_lines(df)).collect() if r.doc_id == 5)
    assert texts == [("5", ""), ("5", rows[-1][1].split("\n")[0])]


def test_recall_of_bands_at_the_threshold():
    """Lines of similarity 0.8 meet in a band with the stated probability, 0.995; what is measured is the operator's own loss."""
    rng = np.random.default_rng(12)
    met, size, apart = [], 180, 20
    for _ in range(40):
        rows = []
        for _ in range(100):
            both = rng.integers(0, 2**63, size + apart, dtype=np.uint64)
            rows += [both[:size], both[apart:]]
        bands = lines._banded(np.concatenate(rows), np.arange(201) * size)
        met += (bands[::2] == bands[1::2]).any(1).tolist()
    assert (size - apart) / (size + apart) == 0.8
    assert np.mean(met) >= 0.99
