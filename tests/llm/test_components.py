import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.llm import text as X
from lamella.llm.components import furthest


@pytest.mark.parametrize("percent, size, words", [(80, 8, 16), (80, 60, 16), (80, 500, 16), (80, 3000, 16), (85, 30, 32), (85, 500, 32), (85, 9000, 32)])
def test_no_link_is_lost_by_sketches(spark, percent, size, words):
    """Sets at the very threshold: 40,000 draws, none beyond the limit, which most pairs well below the threshold exceed."""
    rng = np.random.default_rng(size)
    total = 2 * size
    limit = spark.range(1).select(furthest(F.lit(total), percent, words)).first()[0]
    bits = 64 * words

    def distances(similarity, draws):
        apart = int(total * (1 - similarity) / (1 + similarity) + 1e-9)
        out = []
        for i in range(0, draws, 1000):
            at = np.repeat(np.arange(1000), apart) * bits + rng.integers(0, bits, 1000 * apart)
            out.append((np.bincount(at, minlength=1000 * bits).reshape(1000, bits) & 1).sum(1))
        return np.concatenate(out)

    assert distances(percent / 100, 40_000 if size < 1000 else 4000).max() <= limit
    if 60 <= size <= 3000:
        assert (distances(percent / 100 - 0.15, 1000) > limit).mean() > 0.9


def test_sketches_add_up():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (0, 1, 7, 300, 5000, 0, 40)]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    one = np.stack(X.sketches(np.concatenate(rows), bounds, 4), axis=1)
    assert not one[0].any() and not one[5].any()
    both = [np.setxor1d(a, b) for a, b in zip(rows, rows[::-1])]
    at = np.concatenate([[0], np.cumsum([len(r) for r in both])])
    two = np.stack(X.sketches(np.concatenate(both), at, 4), axis=1)
    assert (two == (one ^ one[::-1])).all()
