"""Learning in blocks with windows, and merging over their borders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenstack import model
from lumenstack.operators import dictionary, filters, segmentation
from lumenstack.plans import pipeline


def stack_of(spark, images):
    return spark.createDataFrame([(t, list(i.shape), i.ravel().tolist()) for t, i in enumerate(np.asarray(images, float))], model.FRAMES)


def test_block_table():
    table = pipeline.block_table((150, 110, 110), [10000, -1, -1], [-1, 2, 2], [50, 20, 20], [0, 5, 5])
    assert [b["own"] for b in table] == [[(0, 150), y, x] for y in ((5, 55), (55, 105)) for x in ((5, 55), (55, 105))]
    assert [b["windowed"] for b in table] == [[(0, 150), y, x] for y in ((5, 75), (35, 105)) for x in ((5, 75), (35, 105))]
    ragged = pipeline.block_table((10,), [4], None, [1], None)
    assert [(b["own"], b["windowed"]) for b in ragged] == [([(0, 4)], [(0, 5)]), ([(4, 8)], [(3, 9)]), ([(8, 10)], [(7, 10)])]
    assert pipeline.block_table((6, 8))[0]["own"] == [(0, 6), (0, 8)]
    for wrong in ({"num_blocks": [4]}, {"block_shape": [4], "num_blocks": [2]}, {"half_border": [5]}):
        with pytest.raises(ValueError):
            pipeline.block_table((10,), **wrong)


@pytest.mark.parametrize("shape", [(9, 7), (4, 5, 6)])
def test_blocks_are_cut_where_frames_lie(spark, shape):
    images = np.random.default_rng(1).random((6, *shape))
    table = pipeline.block_table((6, *shape), None, [3] + [1] * (len(shape) - 1) + [2 if shape[-1] % 2 == 0 else 1], [1] * (len(shape) + 1))
    kinds = {}
    for b in table:
        kinds.setdefault(tuple(e - a for a, e in b["windowed"]), []).append(b["windowed"])
    for (length, *sizes), windows in kinds.items():
        found = {r.t: np.reshape(r.data, r.shape) for r in pipeline.cut_blocks(stack_of(spark, images), shape, windows).collect()}
        assert sorted(found) == list(range(length * len(windows)))
        for k, w in enumerate(windows):
            part = images[tuple(slice(a, e) for a, e in w)]
            assert all(np.array_equal(found[k * length + t], part[t]) for t in range(length))


def test_stacks_do_not_touch(spark):
    """Two stacks that follow each other are preprocessed, and learned, as each alone."""
    images = np.random.default_rng(5).random((16, 6, 7)) + 1
    parameters = {"extract_f0": {"half_window_size": 2, "which_quantile": 0.5, "temporal_smoothing_gaussian_filter_stdev": 1.0, "temporal_smoothing_gaussian_filter_window_size": 2.0, "spatial_smoothing_gaussian_filter_stdev": 0.5}, "wavelet.transform": {"scale": [1, 2, 2]}}
    both = {r.t: r.data for r in pipeline.preprocess_data(stack_of(spark, images), (6, 7), 8, parameters).collect()}
    learned = {"spams.trainDL": {"K": 3, "lambda1": 0.1, "iter": 3, "posAlpha": True, "posD": True}}
    for k in (0, 1):
        alone = pipeline.preprocess_data(stack_of(spark, images[8 * k : 8 * k + 8]), (6, 7), 8, parameters)
        assert all(np.allclose(both[8 * k + r.t], r.data) for r in alone.collect())
    data = stack_of(spark, images).withColumn("stack", F.expr("t div 8"))
    first = np.random.default_rng(6).random((2, 3, 42))
    atoms = dictionary.generate_dictionaries(data, 3, 0.1, 4, initial=first, stacks=2)
    for k in (0, 1):
        assert np.allclose(atoms[k], dictionary.generate_dictionary(stack_of(spark, images[8 * k : 8 * k + 8]), 3, initial=first[k], penalty=0.1, n_iter=4), atol=1e-5)
    frames = pipeline.generate_dictionary(stack_of(spark, images), (6, 7), learned, 8, 2)
    assert sorted(r.t for r in frames.collect()) == list(range(6))


def test_codes_are_optimal():
    """No code can be moved to lower the objective: the conditions of the optimum, with atoms that are much alike."""
    rng = np.random.default_rng(9)
    atoms = rng.random((12, 30)) + 3
    atoms /= np.linalg.norm(atoms, axis=1, keepdims=True)
    x = rng.random((25, 30))
    codes = dictionary.sparse_codes(x, atoms, 0.05)
    slope = (codes @ atoms - x) @ atoms.T + 0.05
    assert (codes >= 0).all() and slope.min() > -1e-5 and np.abs(slope[codes > 1e-6]).max() < 1e-5
    signed = dictionary.sparse_codes(x - 0.5, atoms, 0.05, positive=False)
    slope = (signed @ atoms - x + 0.5) @ atoms.T
    assert np.abs(slope).max() < 0.05 + 1e-5 and np.abs(slope + 0.05 * np.sign(signed))[np.abs(signed) > 1e-6].max() < 1e-5


CONFIG = {
    "preprocess_data": {"normalize_data": {"renormalized_images": {"ord": 2}}},
    "generate_dictionary": {"spams.trainDL": {"K": 10, "lambda1": 0.2, "iter": 10, "posAlpha": True, "posD": True}},
    "postprocess_data": {
        "wavelet_denoising": {
            "estimate_noise": {"significance_threshold": 3.0},
            "wavelet.transform": {"scale": 3},
            "significant_mask": {"noise_threshold": 3.0},
            "accepted_region_shape_constraints": {"major_axis_length": {"min": 0.0, "max": 40.0}},
            "accepted_neuron_shape_constraints": {"area": {"min": 9, "max": 900}},
            "remove_low_intensity_local_maxima": {"percentage_pixels_below_max": 0.0},
            "remove_too_close_local_maxima": {"min_local_max_distance": 8.0},
        },
        "merge_neuron_sets": {"alignment_min_threshold": 0.6, "overlap_min_threshold": 0.6, "fuse_neurons": {"fraction_mean_neuron_max_threshold": 0.01}},
    },
}


def test_neurons_on_the_borders_of_blocks(spark):
    """Four blocks of one plan; one neuron lies on the border between two of them, one in the corner of all, and each is found once, where it is."""
    at = np.indices((64, 64))
    centres = [(15, 15), (48, 31), (32, 49), (14, 46)]
    bumps = [15 * np.exp(-((at[0] - y) ** 2 + (at[1] - x) ** 2) / 18.0) for y, x in centres]
    ramp = np.r_[np.linspace(0.1, 1, 5), np.linspace(1, 0.1, 5)]
    images = np.concatenate([ramp[:, None, None] * b for b in bumps])
    found = pipeline.generate_neurons_blocks(stack_of(spark, images), (64, 64), len(images), CONFIG, [10000, -1, -1], [-1, 2, 2], [50, 14, 14], [0, 2, 2])
    assert sorted(tuple(round(c) for c in r.centroid) for r in found.collect()) == sorted(centres)


def test_zeroed_lines_are_filled(spark):
    """Columns of zeros next to each other, at the border and inside, on planes and slopes."""
    ones, down, across = np.ones((100, 101)), np.repeat(np.arange(100.0)[:, None], 101, 1), np.repeat(np.arange(100.0)[None], 101, 0)
    across[:, 0] = 1
    for image, columns in ((ones, [98, 3, 4]), (ones, [1, 3, 4]), (ones, [100, 0, 4]), (ones, [100, 99, 0, 1]), (ones, [5, 6, 7, 8, 60]), (down, [1, 3, 4]), (across, [0, 2, 3, 4])):
        cut = image.copy()
        cut[:, columns] = 0
        stack = spark.createDataFrame([(0, list(cut.shape), cut.ravel().tolist())], model.FRAMES)
        found = np.reshape(segmentation.fill_zeroed_frames(stack, [21, 1], [1, 3]).first().data, cut.shape)
        assert np.allclose(found, image, rtol=0, atol=1e-12), columns


def test_ragged_holes_on_slopes():
    """A hole of any form on a slope is filled with the slope, in two and in three dimensions; what is outside the outline's hull gets 0."""
    rng = np.random.default_rng(3)
    y, x = np.indices((20, 22)).astype(float)
    slope = 5 + 2 * y + 3 * x
    hole = np.zeros(slope.shape, bool)
    hole[6:12, 5:13] = rng.random((6, 8)) < 0.8
    hole[8, 5:13] = True
    cut = np.where(hole, 0, slope)
    assert np.allclose(segmentation.filled_holes(cut, [1, 1], [3, 3]), slope, atol=1e-9)
    z, y, x = np.indices((9, 10, 11)).astype(float)
    slope = 1 + z + 2 * y + 3 * x
    hole = np.zeros(slope.shape, bool)
    hole[3:6, 3:6, 4:7] = rng.random((3, 3, 3)) < 0.8
    assert np.allclose(segmentation.filled_holes(np.where(hole, 0, slope), [1, 1, 1], [3, 3, 3]), slope, atol=1e-9)
    image = np.ones((5, 5))
    image[2, :] = 0
    assert np.array_equal(segmentation.interpolated(np.array([[0, 0], [0, 4], [4, 0]]), np.array([1.0, 2.0, 3.0]), np.array([[1, 1], [4, 4]])), [1.75, 0.0])


def test_triangles_are_delaunay():
    """The corners found hold no other point within their circle, and their weights make up the place."""
    rng = np.random.default_rng(8)
    points = np.unique(rng.integers(0, 40, (60, 2)), axis=0)
    for _ in range(60):
        at = rng.integers(0, 40, 2)
        found = segmentation.delaunay_weights(points, at)
        corners, weights = found if found else ([], [])
        if not len(corners):
            continue
        assert np.allclose(weights @ points[corners], at) and (weights > -1e-9).all()
        if len(corners) == 3 and abs(np.linalg.det(np.c_[points[corners], np.ones(3)])) > 1e-9:
            a = np.c_[2 * points[corners], np.ones(3)]
            cx, cy, c = np.linalg.solve(a, (points[corners] ** 2).sum(1).astype(float))
            assert (((points - [cx, cy]) ** 2).sum(1) >= c + cx * cx + cy * cy - 1e-6).all()


@pytest.mark.parametrize("half, n", [(20, 300), (40, 60), (400, 900), (3, 50)])
def test_sliding_rank(spark, half, n):
    series = np.random.default_rng(half).integers(0, 50, (2, n)).astype(float)
    rows = [(t, 0, x, float(series[x, t])) for x in (0, 1) for t in range(n)]
    pixels = spark.createDataFrame(rows, model.PIXELS).repartition(3)
    rank = round(0.3 * 2 * half)
    expected = {}
    for x in (0, 1):
        taken = filters.reached(np.arange(-half, n + half), n, "mirror")
        for t in range(n):
            expected[t, x] = np.sort(series[x][taken[t : t + 2 * half + 1]])[rank]
    for block in (None, 64):
        found = filters.along(pixels, "t", n, half, lambda w: filters.sliding_rank(w, half, rank), block=block)
        assert {(r.t, r.x): r.v for r in found.collect()} == expected
    with pytest.raises(Exception, match="complete"):
        filters.rank_filter(pixels.filter("t <> 7"), half, 0.3, n).collect()
