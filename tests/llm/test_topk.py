import math

import numpy as np

from lamella.llm import topk
from lamella.session import ship


def brute(rows, every, k):
    best = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            best[i] = min(best.get(i, tuple(v)), tuple(v))
    whole = {i: [math.floor(64 * x) for x in v] for i, v in best.items()}
    out = []
    for q in whole:
        if q % every == 0:
            scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[q], whole[c])))), c) for c in whole if c != q and len(whole[c]) == len(whole[q]))
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scores[:k])]
    return sorted(out)


def check(spark, rows, every=5, k=4):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, score string")
    got = sorted(tuple(r) for r in topk.top_k(df, every=every, k=k).collect())
    assert got == brute([(r[0], r[1]) for r in rows], every, k)


def test_odd_rows(spark):
    ship(spark)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=3).tolist(), 0, "x") for i in range(40)]
    rows += [(5, [0.1, 0.2, 0.3], 1, None)] * 3 + [(50 + i, [1.0, 1.0, 1.0], None, None) for i in range(10)]
    rows += [(100, None, 0, ""), (101, [1.0, None, 2.0], 0, ""), (105, [1.0, float("nan"), 2.0], 0, ""), (110, [float("inf"), 0.0, 0.0], 0, ""), (None, [1.0, 1.0, 1.0], 0, "")]
    rows += [(200, [1.0, 2.0], 0, ""), (201, [3.0, 4.0], 0, ""), (205, [], 0, ""), (206, [], 0, ""), (-10, [0.5, 0.5, 0.5], 0, "")]
    check(spark, rows)


def test_large_numbers(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=4) * 10.0 ** rng.integers(0, 20)).tolist(), 0, "") for i in range(60)] + [(100, [1.5e306, -1e300, 0.0, 1.0], 0, "")]
    check(spark, rows)


def test_many_shards_and_leaves(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 100)
    monkeypatch.setattr(topk, "QUERY_ROWS", 10)
    monkeypatch.setattr(topk, "GROUP", 2)
    monkeypatch.setattr(topk, "SAMPLE", 50)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.1 * rng.normal(size=8)).tolist(), 0, "") for i in range(900)]
    check(spark, rows, every=20, k=7)


def test_pruning_prunes():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(16, 8)) * 20
    vectors = np.floor(np.repeat(centres, 256, axis=0) + rng.normal(size=(4096, 8)))
    order, nodes = topk._ball_tree(vectors)
    v = vectors[order]
    c = np.array([v[a:z].mean(0) for a, z, _, _ in nodes])
    r = np.array([np.sqrt(((v[a:z] - m) ** 2).sum(1).max()) for (a, z, _, _), m in zip(nodes, c)])
    best = topk.Best(np.array([-1]), vectors[:1], 5)
    seen = []
    offer = best.offer
    best.offer = lambda rows, ids, scores: (seen.append(len(ids)), offer(rows, ids, scores))
    best.search(np.arange(4096)[order], v, np.array(nodes), c, r)
    assert sum(seen) < 2048
    assert sorted(best.score[0].tolist(), reverse=True) == sorted((vectors @ vectors[0]).astype(int).tolist(), reverse=True)[:5]


def test_empty(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_blocks_meet_few_shards(spark, monkeypatch):
    """In clustered data most shards' bodies never move to a block; the result stays exact."""
    monkeypatch.setattr(topk, "SHARD_ROWS", 60)
    monkeypatch.setattr(topk, "QUERY_ROWS", 20)
    met = {}

    def cut(df, *args):
        out = cut_(df, *args)
        for name in ("place", "root", "floor"):
            if name in df.columns:
                met[name] = out.count()
        return out

    cut_ = topk.cut
    monkeypatch.setattr(topk, "cut", cut)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 8)) * 4
    rows = [(i, (centres[i % 12] + 0.1 * rng.normal(size=8)).tolist(), 0, "") for i in range(1200)] + [(2000 + i, [1.0] * 8, 0, "") for i in range(300)]
    check(spark, rows, every=7, k=5)
    assert met["root"] >= 20 and met["floor"] >= 8
    assert met["place"] < 0.4 * met["root"] * met["floor"]
