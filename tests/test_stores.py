"""Masked stacks that change their sizes."""

import numpy as np
import pytest

from lumenstack.sources import store


@pytest.mark.parametrize("after", [(3, 4, 5), (5, 4, 5), (2, 3, 4), (4, 2, 7), (3, 6, 2), (0, 4, 5), (6, 6, 6)])
def test_resized(spark, after):
    before = (3, 4, 5)
    rng = np.random.default_rng(1)
    values, masks = rng.random(before) + 1, rng.random(before) < 0.3
    rows = [(*map(int, p), float(values[p]), bool(masks[p])) for p in np.ndindex(before)]
    pixels = spark.createDataFrame(rows, "t bigint, y bigint, x bigint, v double, masked boolean")
    data, mask = np.zeros(after), np.zeros(after, bool)
    common = tuple(slice(0, min(a, b)) for a, b in zip(before, after))
    data[common], mask[common] = values[common], masks[common]
    found = store.resized(pixels, before, after).collect()
    assert sorted((r.t, r.y, r.x, r.v, r.masked) for r in found) == sorted((*p, data[p], mask[p]) for p in np.ndindex(after))
