"""Contours at a distance, enumerated masks, numbered rows, and random samples."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenstack import model
from lumenstack.functions import sequences
from lumenstack.operators import random_sample as rs, regions


def stack_of(spark, images):
    return spark.createDataFrame([(t, list(np.shape(i)), np.asarray(i, float).ravel().tolist()) for t, i in enumerate(images)], model.FRAMES)


@pytest.mark.parametrize("shape", [(1, 7), (6, 9), (4, 5, 6)])
def test_distances_by_brute_force(shape):
    rng = np.random.default_rng(1)
    for share in (0.0, 0.1, 0.5, 0.95):
        mask = rng.random(shape) < share
        holes, out = np.argwhere(~mask), np.zeros(shape)
        for p in np.argwhere(mask):
            out[tuple(p)] = ((holes - p) ** 2).sum(1).min() if len(holes) else np.inf
        assert np.array_equal(regions.squared_distances(mask), out)
    assert np.isinf(regions.squared_distances(np.ones(shape, bool))).all()


#: The published example of a mask and its labelled contours.
MASK = [[0, 0, 1, 0, 0, 0, 1], [1, 0, 0, 0, 1, 0, 0], [1, 1, 0, 1, 1, 0, 1], [1, 0, 0, 1, 1, 0, 0], [1, 0, 0, 0, 0, 0, 0], [0, 1, 0, 0, 0, 0, 1], [0, 1, 1, 0, 0, 0, 0]]
LABELS = [[0, 0, 1, 0, 0, 0, 2], [3, 0, 0, 0, 4, 0, 0], [3, 3, 0, 4, 4, 0, 5], [3, 0, 0, 4, 4, 0, 0], [3, 0, 0, 0, 0, 0, 0], [0, 3, 0, 0, 0, 0, 6], [0, 3, 3, 0, 0, 0, 0]]


def test_contours(spark):
    square = np.zeros((9, 9))
    square[1:8, 1:8] = 2.0
    rows = {r.t: r for r in regions.labeled_contours(stack_of(spark, [MASK, np.eye(7)])).collect()}
    assert np.array_equal(np.reshape(rows[0].labels, (7, 7)), LABELS) and np.array_equal(np.reshape(rows[0].data, (7, 7)), MASK)
    assert np.array_equal(np.reshape(rows[1].labels, (7, 7)), np.eye(7))
    ring = np.reshape(regions.band_contours(stack_of(spark, [square]), 2.0, 0.5).first().data, (9, 9))
    inner = np.zeros((9, 9))
    inner[2:7, 2:7] = 2.0
    inner[3:6, 3:6] = 0
    assert np.array_equal(ring, inner)
    assert not any(regions.band_contours(stack_of(spark, [np.ones((3, 3))])).first().data)


def test_enumerated_masks(spark):
    rows = [(g, k, 0, x) for g in (0, 1) for k in (3, 5, 9) for x in range(k - 2)]
    table = spark.createDataFrame(rows, "g bigint, k bigint, y bigint, x bigint")
    for by in (["g"], []):
        assert {(r.k, r.number) for r in regions.enumerate_masks(table, by).collect()} == {(3, 1), (5, 2), (9, 3)}
    most = {(r.g, r.x): r.number for r in regions.enumerate_masks_max(table, ["g"]).collect()}
    assert most == {(g, x): 3 for g in (0, 1) for x in range(7)}


def test_numbered_rows(spark):
    table = spark.range(100, 111).repartition(4)
    found = sorted(tuple(r) for r in sequences.filled_stringify_enumerate(table, ["id"]).collect())
    assert found == [(100 + k, k, f"{k:02d}") for k in range(11)]
    assert sorted(tuple(r) for r in sequences.filled_stringify_range(table.limit(2), ["id"]).collect()) == [(0, "0"), (1, "1")]
    assert sequences.filled_stringify_enumerate(table.limit(0), ["id"]).count() == 0


def test_draws(spark):
    """Frequencies within five deviations of what the distributions say."""
    n = 20_000
    rows = spark.range(n)
    drawn = Counter(r.drawn for r in rs.uniform_mapping(rows, ["a", "b", "c"], 1).collect())
    assert set(drawn) == {"a", "b", "c"} and all(abs(c - n / 3) < 5 * math.sqrt(n * 2 / 9) for c in drawn.values())
    assert rs.uniform_mapping(rows, [], 1).filter("drawn is not null").count() == 0
    sizes = Counter(r.s for r in rows.select(rs.geometric(0.3, 2, "s", F.col("id")).alias("s")).collect())
    for k in range(1, 6):
        p = 0.7 ** (k - 1) * 0.3
        assert abs(sizes[k] - n * p) < 5 * math.sqrt(n * p * (1 - p))
    assert min(sizes) == 1 and {r.s for r in rows.select(rs.geometric(1, 2, "s", F.col("id")).alias("s")).collect()} == {1}
    with pytest.raises(ValueError):
        rs.geometric(0, 1, "s")
    groups = rs.geometric_groups(rows, F.lit(4), 0.5, 3).groupBy("place").count().collect()
    total = sum(r["count"] for r in groups)
    assert len(groups) == 4 and abs(total - 2 * n) < 5 * math.sqrt(2 * n) and all(abs(r["count"] - total / 4) < 5 * math.sqrt(total * 3 / 16) for r in groups)


def test_sample(spark):
    def drawn(partitions):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            s = rs.dictionary_sample(spark, (12, 15), 8, 5, 4, 2.0, 1.0, 9.0, 4.0, 0.1, num_runs=2, seed=7)
            return [sorted(tuple(r) for r in df.collect()) for df in (s.points, s.activations, s.noiseless, s.frames)]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")

    points, lit, clean, noisy = drawn("1")
    assert [points, lit, clean, noisy] == drawn("8")
    assert {p[0] for p in points} == {0, 1} and len(points) <= 16 and {p[:1] + p[2:4] for p in lit} <= set(points)
    assert all(4.0 <= v <= 9.0 for *_, v in lit) and len(clean) == len(noisy) == 2 * 5 * 4
    for run, t, shape, data in clean:
        own = {(y, x): v for r, g, y, x, v in lit if (r, g) == (run, t // 4)}
        assert shape == [12, 15] and math.isclose(sum(data), sum(own.values()) * (4 - t % 4) / 4, rel_tol=1e-9)
    spread = np.concatenate([np.subtract(a[3], b[3]) for a, b in zip(noisy, clean)])
    assert abs(spread.std() - 0.1) < 0.005 and abs(spread.mean()) < 0.01
