"""The kernels under the operators against their plain definitions."""

import numpy as np

from lamella.llm import text as X


def test_distinct_by_row():
    rng = np.random.default_rng(1)
    many = rng.integers(0, 9, 200)
    bounds = np.concatenate([[0], np.cumsum(many)])
    values = rng.integers(0, 5, bounds[-1]).astype(np.uint64)
    items, limits = X.distinct_by_row(values, bounds)
    rows = [np.unique(values[i:j]).tolist() for i, j in zip(bounds[:-1], bounds[1:])]
    assert [items[i:j].tolist() for i, j in zip(limits[:-1], limits[1:])] == rows


def test_mix_is_by_parts():
    x = np.random.default_rng(2).integers(0, 2**63, 3 * X.MIXED + 5, dtype=np.uint64)
    kept, whole = x.copy(), X.mix(x)
    y = (x ^ (x >> X.U(30))) * X.U(0xBF58476D1CE4E5B9)
    y = (y ^ (y >> X.U(27))) * X.U(0x94D049BB133111EB)
    assert (whole == y ^ (y >> X.U(31))).all() and (x == kept).all()
