import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.llm import neardup
from lamella.llm import queries as Q
from lamella.llm import text as X
from lamella.llm.components import buckets, components, hooking, resolve
from lamella.llm.neardup import near_duplicates
from lamella.session import ship
from tests.conftest import SF
from tests.llm.brute import groups, shingle_set


def test_query(spark):
    ship(spark)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sets = {i: shingle_set(t) for i, t in docs.items()}
    want = groups(sets, 85)
    got = Q.op7_neardup(spark, SF).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, len(sets[i]), want[i], want[i] == i) for i in sets}


def edited(words, rng, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_large_group_of_near_copies(spark):
    """Copies of copies, some linked through others alone, in one bucket with unlinked texts."""
    rng = random.Random(5)
    base = [f"v{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(i, edited(base, rng, rng.choice([0, 1, 2, 4, 9, 14]))) for i in range(300)]
    rows += [(1000 + i, " ".join(rng.choice("abc") for _ in range(30))) for i in range(60)]
    sets = {i: shingle_set(t) for i, t in rows}
    want = groups(sets, 85)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_odd_rows(spark):
    same = "one two three four five six seven"
    rows = [(3, same), (2, same.upper()), (2, same.upper()), (None, same), (None, "alone here"), (4, None), (5, ""), (6, " \t\n"), (7, "short one"), (8, "short  ONE"), (9, "x" * 200_000), (10, "y " * 100_000), (11, "é x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h1", F.lit("clash")).withColumn("n_shingles", F.lit(0))
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect())
    want = [("3", 3, 2, False), ("2", 3, 2, True), ("2", 3, 2, True), ("None", 3, 2, False), ("None", 1, None, True), ("4", 0, 4, True), ("5", 0, 5, True), ("6", 0, 6, True), ("7", 1, 7, True), ("8", 1, 7, False), ("9", 1, 9, True), ("10", 1, 10, True), ("11", 1, 11, True)]
    assert got == sorted(want)
    assert near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("shape", ["chain", "star", "random", "long chain"])
def test_components(spark, shape):
    rng = random.Random(2)
    edges = {"chain": [(i, i + 1) for i in range(60)], "star": [(7, i) for i in range(50)], "long chain": [(i, i + 1) for i in range(1000)], "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]}[shape]
    root = {}

    def find(n):
        while root.setdefault(n, n) != n:
            n = root[n]
        return n

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    links = spark.createDataFrame(edges, "a long, b long")
    got = components(links)
    assert {(r.node, r.root) for r in got.collect()} == {(n, find(n)) for n in root}
    if shape == "long chain":
        assert len(hooking(links)[1]) <= 15


def test_no_link_of_a_crowded_bucket_is_lost(spark):
    """All nodes share a bucket; links form a pattern that no single pivot sees."""
    n = 90
    links = {(a, b) for a in range(n) for b in range(a + 1, n) if a % 9 == b % 9 and b - a <= 18}
    truth = spark.createDataFrame(sorted(links), "a long, b long")
    met = spark.createDataFrame([(1, i, 0) for i in range(n)], "key long, node long, at int")
    abouts = spark.createDataFrame([(i, (50,)) for i in range(n)], "node long, about struct<size:long>")
    roots = resolve(buckets(met, abouts), 80, lambda pairs: pairs.join(truth, ["a", "b"]), small=4, tries=2, pivots=4)
    assert {(r.node, r.root) for r in roots.collect()} == {(i, i % 9) for i in range(n)}


def test_recall_of_tables_at_the_threshold():
    """Sets of similarity 0.85 meet in a table, an equal sub-key on either side, with the stated probability, 0.999."""
    rng = np.random.default_rng(13)
    size, apart, met = 400, 32, []
    for _ in range(30):
        rows = []
        for _ in range(100):
            both = rng.integers(0, 2**63, size + apart, dtype=np.uint64)
            rows += [both[:size], both[apart:]]
        mins = X.min_hashes(np.concatenate(rows), np.arange(201) * size, 2 * neardup.SIDE * neardup.DEPTH)
        same = (mins[:, ::2] == mins[:, 1::2]).reshape(2, neardup.SIDE, neardup.DEPTH, -1).all(2).any(1)
        met += same.all(0).tolist()
    assert abs((size - apart) / (size + apart) - 0.85) < 0.003 and np.mean(met) >= 0.997
