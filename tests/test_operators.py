import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenstack import model
from lumenstack.functions import arrays, sequences
from lumenstack.operators import dictionary, filters, neurons, noise, pairwise, regions, registration, renorm, segmentation, synthetic, traces
from lumenstack.plans import pipeline
from lumenstack.sources import config, store, tiff
from lumenstack.streaming import frames as streams


def stack_of(spark, images):
    images = np.asarray(images, float)
    rows = [(t, list(image.shape), image.ravel().tolist()) for t, image in enumerate(images)]
    return spark.createDataFrame(rows, model.FRAMES)


def image_of(pixels, shape, value="v"):
    out = np.full(shape, np.nan)
    for r in pixels.collect():
        out[r.t, r.y, r.x] = r[value]
    return out


@pytest.fixture(scope="module")
def noisy():
    return np.random.default_rng(1).normal(size=(6, 7, 9))


def test_forms_round_trip(spark, noisy):
    stack = stack_of(spark, noisy)
    px = model.to_pixels(stack)
    assert np.array_equal(image_of(px, noisy.shape), noisy)
    assert {r.t: r.data for r in model.to_frames(px, (7, 9)).collect()} == {r.t: r.data for r in stack.collect()}


def test_normalisation(spark, noisy):
    images = noisy.copy()
    images[2] = 4.0
    got = {r.t: np.reshape(r.data, (7, 9)) for r in renorm.normalize_data(stack_of(spark, images)).collect()}
    for t, image in enumerate(images):
        centred = image - image.mean()
        norm = np.linalg.norm(centred)
        assert np.allclose(got[t], centred / norm if norm > 1e-9 else got[t])
    assert np.allclose([renorm_value(spark, [3.0, -4.0], o) for o in (1, 2, 3, float("inf"))], [7, 5, 91 ** (1 / 3), 4])
    with pytest.raises(ValueError):
        renorm.vector_norm(F.lit(1), 0)


def renorm_value(spark, values, ord):
    return spark.createDataFrame([(values,)], "v array<double>").select(renorm.vector_norm(F.col("v"), ord)).first()[0]


def test_noise(spark, noisy):
    got = {r.t: r.noise for r in noise.estimate_noise(model.to_pixels(stack_of(spark, noisy)), 1.5).collect()}
    for t, image in enumerate(noisy):
        assert math.isclose(got[t], image[abs(image - image.mean()) < 1.5 * image.std()].std())
    flat = noise.estimate_noise(model.to_pixels(stack_of(spark, np.ones((1, 2, 2))))).first()
    assert math.isnan(flat.noise)


def mirror(image, axis, kernel):
    half = max(kernel)
    padded = np.pad(image, [(half, half) if a == axis else (0, 0) for a in range(image.ndim)], mode="reflect")
    n = image.shape[axis]
    return sum(w * np.take(padded, range(half + o, half + o + n), axis) for o, w in kernel.items())


def test_axis_filters(spark, noisy):
    px = model.to_pixels(stack_of(spark, noisy))
    for axis, name in enumerate("tyx"):
        kernel = filters.gaussian_kernel(1.0, 2.0)
        assert np.allclose(image_of(filters.axis_filter(px, name, kernel, noisy.shape[axis]), noisy.shape), mirror(noisy, axis, kernel))
    assert filters.binomial_kernel(2) == {-4: 0.0625, -2: 0.25, 0: 0.375, 2: 0.25, 4: 0.0625}
    assert filters.binomial_coefficients(4) == [1, 4, 6, 4, 1]


def test_wavelet_bands_add_up(spark, noisy):
    px = model.to_pixels(stack_of(spark, noisy))
    bands = filters.wavelet_transform(px, {"y": 2, "x": 1}, {"y": 7, "x": 9}, include_lower_scales=True)
    one = mirror(mirror(noisy, 1, filters.binomial_kernel(1)), 2, filters.binomial_kernel(1))
    two = mirror(one, 1, filters.binomial_kernel(2))
    assert np.allclose(image_of(bands.filter("band = 1"), noisy.shape), noisy - one)
    assert np.allclose(image_of(bands.filter("band = 2"), noisy.shape), one - two)


def test_rank_filter_and_background(spark, noisy):
    px = model.to_pixels(stack_of(spark, noisy))
    padded = np.pad(noisy, [(2, 2), (0, 0), (0, 0)], mode="reflect")
    expected = np.sort(np.stack([padded[k : k + 6] for k in range(5)]), axis=0)[1]
    assert np.allclose(image_of(filters.rank_filter(px, 2, 0.25, 6), noisy.shape), expected)
    constant = model.to_pixels(stack_of(spark, np.ones((6, 3, 3))))
    f0 = traces.estimate_f0(constant, 2, 0.5, {"t": 6, "y": 3, "x": 3}, temporal_stdev=1.0, spatial_stdev=1.0, window_size=2.0)
    assert np.allclose(image_of(f0, (6, 3, 3)), 1.0)


def test_morphology_borders(spark):
    mask = np.random.default_rng(3).random((1, 8, 8)) < 0.15
    px = model.to_pixels(stack_of(spark, mask)).filter("v = 1").select("t", "y", "x")
    footprint = [(0, 2), (-1, 0)]
    padded = np.pad(mask[0], 2, mode="symmetric")
    expected = padded[2:10, 4:12] | padded[1:9, 2:10]
    assert {(r.y, r.x) for r in filters.binary_dilation(px, footprint, (8, 8)).collect()} == set(zip(*map(lambda a: a.tolist(), np.nonzero(expected))))


def test_labels_maxima_and_properties(spark):
    image = np.zeros((12, 12))
    image[1:4, 1:5] = 2.0
    image[7:9, 7:9] = 3.0
    image[2, 2] = 5.0
    stack = stack_of(spark, [image])
    props = {r.label: r for r in regions.region_properties(regions.label_components(stack, 0.0), ["t", "label"]).collect()}
    assert {k: (r.area, r.cy, r.cx) for k, r in props.items()} == {1: (12, 2.0, 2.5), 2: (4, 7.5, 7.5)}
    assert math.isclose(props[1].major_axis_length, 4 * math.sqrt(np.var([1, 2, 3, 4])))
    assert {(r.y, r.x) for r in regions.extended_local_maxima(stack).collect()} == {(2, 2), (8, 8)}
    assert not regions.extended_maxima(np.ones((3, 3))).any()
    diagonal = np.eye(3, dtype=bool)
    assert regions.label_image(diagonal, 4).max() == 3 and regions.label_image(diagonal, 8).max() == 1
    spiral = np.array([[1, 1, 1, 1], [0, 0, 0, 1], [1, 1, 0, 1], [1, 0, 0, 1], [1, 1, 1, 1]], bool)
    assert regions.label_image(spiral).max() == 1


def test_watershed_parts_two_basins():
    image = np.array([[1, 2, 3, 9, 3, 2, 1.0]])
    markers = np.array([[1, 0, 0, 0, 0, 0, 2]])
    assert regions.watershed(image, markers, image > 0).tolist() == [[1, 1, 1, 1, 2, 2, 2]]


def test_maxima_filters(spark):
    peaks = spark.createDataFrame([(0, 1, 5, 5, 9.0), (0, 1, 5, 7, 8.0), (0, 1, 5, 9, 7.0), (0, 2, 5, 6, 1.0)], "t bigint, label bigint, y bigint, x bigint, v double")
    left = regions.remove_too_close_local_maxima(peaks, 2.5, ["t", "label"])
    assert {(r.label, r.x) for r in left.collect()} == {(1, 5), (2, 6)}
    pixels = spark.createDataFrame([(0, 1, 9.0), (0, 1, 8.5), (0, 1, 1.0), (0, 2, 1.0)], "t bigint, label bigint, v double")
    kept = regions.remove_low_intensity_local_maxima(peaks, pixels, 0.3)
    assert {(r.label, r.x) for r in kept.collect()} == {(1, 5), (1, 7), (1, 9)}


def test_zeroed_lines_on_planes(spark):
    y, x = np.mgrid[:20, :21]
    plane = (3.0 * x + 2.0 * y + 5)[None]
    broken = plane.copy()
    broken[:, :, [4, 9, 20]] = 0
    fixed = image_of(segmentation.remove_zeroed_lines(model.to_pixels(stack_of(spark, broken)), (20, 21), filters.box(5, 0)), plane.shape)
    assert np.allclose(fixed[:, :, :20], plane[:, :, :20]) and np.allclose(fixed[:, :, 20], plane[:, :, 19])


def test_registration_of_a_moved_block(spark):
    images = np.zeros((12, 10, 11))
    images[:, 3:7, 4:8] = 1
    images[5] = np.roll(images[5], (2, -3), (0, 1))
    stack = stack_of(spark, images)
    shifts = registration.register_mean_offsets(stack, (10, 11))
    assert {r.t: (r.dy, r.dx) for r in shifts.collect()} == {t: (-2, 3) if t == 5 else (0, 0) for t in range(12)}
    rolled = registration.roll_by(model.to_pixels(stack), shifts, (10, 11))
    assert np.array_equal(image_of(rolled, images.shape), np.repeat(images[:1], 12, 0))
    assert rolled.filter("masked").groupBy("t").count().collect() == [(5, 10 * 11 - 8 * 8)]
    assert registration.truncate_masked(rolled).groupBy("t").count().first()[1] == 64


def test_pairwise_and_mappings(spark):
    rng = np.random.default_rng(5)
    a = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(5, 4)))]
    b = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(4, 4)))] + [(4, [0.0] * 4)]
    da, db = (spark.createDataFrame(r, "id bigint, v array<double>") for r in (a, b))
    got = {(r.i, r.j): r.value for r in pairwise.dot_product_normalized(da, db, ord=1).collect()}
    for i, x in a:
        for j, y in b:
            bottom = np.abs(x).sum() * np.abs(y).sum()
            assert math.isnan(got[i, j]) if not bottom else math.isclose(got[i, j], np.dot(x, y) / bottom, rel_tol=1e-9, abs_tol=1e-12)
    edges = spark.createDataFrame([(0, 0), (1, 1), (1, 2), (3, 3), (4, 3), (5, 6)], "i bigint, j bigint")
    assert {(r.i, r.j) for r in pairwise.unique_mapping(edges).collect()} == {(0, 0), (5, 6)}
    assert tuple(pairwise.compute_mapping_matches(edges, 7, 8).first()) == (2, 5, 6)


def test_array_functions(spark):
    row = spark.createDataFrame([([1.0, -3.0, float("nan"), 3.0, 0.5],)], "v array<double>")
    found = row.select(arrays.max_abs(F.col("v")).alias("a"), arrays.nanmax_abs(F.col("v")).alias("b"), arrays.nanmin_abs(F.col("v")).alias("c")).first()
    assert math.isnan(found.a.value) and tuple(found.b) == (-3.0, 1) and tuple(found.c) == (0.5, 4)
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3)], "v double")
    assert {r.q: r.v for r in arrays.quantile(df, "v", [0.25, 0.5]).collect()} == {0.25: 1.25, 0.5: 2.0}
    assert arrays.get_quantiles(3) == [0.25, 0.5, 0.75]
    with pytest.raises(ValueError):
        arrays.get_quantiles([0.0])
    cube = np.arange(24).reshape(2, 3, 4)
    flat = spark.createDataFrame([(cube.ravel().tolist(),)], "v array<bigint>")
    for axis, pos in ((0, 1), (1, -1), (2, 2)):
        assert flat.select(arrays.index_axis_at_pos(F.col("v"), cube.shape, axis, pos)).first()[0] == np.take(cube, pos, axis).ravel().tolist()
    assert flat.select(arrays.unsquish(F.col("v"), 12)).first()[0] == cube.reshape(2, 12).tolist()
    assert spark.range(1).select(arrays.expand_arange(1, 4, reps_before=2, reps_after=2)).first()[0] == [1, 1, 2, 2, 3, 3] * 2
    assert arrays.line_filter((1, 2)) == [(0, -2), (0, -1), (0, 0), (0, 1), (0, 2)]


def test_sequences(spark):
    assert [tuple(r) for r in sequences.index_enumerator(spark, 2, 3).collect()] == [(a, b) for a in range(2) for b in range(3)]
    assert [r.id for r in sequences.range_with_skip(spark, 0, 10, 3, [6]).collect()] == [0, 3, 9]
    padded = sequences.filled_stringify_numbers(spark.range(8, 12), "id")
    assert sorted(r.padded for r in padded.collect()) == ["08", "09", "10", "11"]


def test_dictionary_finds_the_planted_discs(spark):
    masks = np.zeros((3, 16, 16))
    for k, (y, x) in enumerate([(4, 4), (11, 5), (8, 12)]):
        yy, xx = np.mgrid[:16, :16]
        masks[k] = (yy - y) ** 2 + (xx - x) ** 2 < 9
    rng = np.random.default_rng(2)
    weights = rng.random((60, 3)) * (rng.random((60, 3)) < 0.4)
    weights[np.arange(3), np.arange(3)] = 1.0
    stack = stack_of(spark, np.einsum("tk,kyx->tyx", weights, masks))
    atoms = dictionary.generate_dictionary(stack, 3, penalty=0.05, n_iter=25, initial=masks.reshape(3, -1) + 0.3 * rng.random((3, 256)))
    supports = {tuple(np.flatnonzero(a > 0.3 * a.max())) for a in atoms}
    assert supports == {tuple(np.flatnonzero(m)) for m in masks.reshape(3, -1)}


SCENE = [(14, 14), (14, 44), (44, 18), (45, 46)]


def planted(spark, shape=(60, 60)):
    yy, xx = np.mgrid[: shape[0], : shape[1]]
    return np.array([sum(15 * np.exp(-((yy - y) ** 2 + (xx - x) ** 2) / 18.0) for y, x in SCENE[k::2]) for k in (0, 1)])


def test_wavelet_denoising_and_merging(spark):
    images = planted(spark)
    px = model.to_pixels(stack_of(spark, np.concatenate([images, images[:1]])))
    found = segmentation.wavelet_denoising(px, (60, 60), wavelet_scale=3, noise_threshold=3.0, accepted_neuron_shape_constraints={"area": {"min": 9, "max": 900}})
    centres = {(r.t, *(round(c) for c in r.centroid)) for r in found.collect()}
    assert centres == {(0, *SCENE[0]), (0, *SCENE[2]), (1, *SCENE[1]), (1, *SCENE[3]), (2, *SCENE[0]), (2, *SCENE[2])}
    merged = neurons.merge_neuron_sets(found, (60, 60), 0.6, 0.6)
    assert {tuple(round(c) for c in r.centroid) for r in merged.collect()} == set(SCENE) and merged.count() == 4


PARAMETERS = {
    "run_stage": "all",
    "preprocess_data": {"normalize_data": {"renormalized_images": {"ord": 2}}},
    "generate_dictionary": {"spams.trainDL": {"K": 4, "lambda1": 0.1, "iter": 12, "posAlpha": True, "posD": True}},
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


def test_pipeline_finds_planted_neurons_and_resumes(spark, tmp_path):
    images = planted(spark)
    ramp = np.r_[np.linspace(0.1, 1, 8), np.linspace(1, 0.1, 8)]
    stack = stack_of(spark, np.concatenate([ramp[:, None, None] * image for image in images]))
    kept = store.recorder(spark, str(tmp_path / "run"), overwrite=True)
    found = pipeline.generate_neurons(stack, (60, 60), 32, PARAMETERS, kept)
    assert {tuple(round(c) for c in r.centroid) for r in found.collect()} == set(SCENE)
    again = pipeline.generate_neurons(stack.limit(0), (60, 60), 32, PARAMETERS | {"run_stage": ""}, kept)
    assert again.count() == found.count()


def test_blocks_cover_the_frame():
    found = pipeline.blocks((10, 9), (2, 3), (2, 1))
    cells = [(y, x) for b in found for y in range(*b["own"][0]) for x in range(*b["own"][1])]
    assert sorted(cells) == [(y, x) for y in range(10) for x in range(9)]
    assert found[0]["with_border"] == [(0, 7), (0, 4)]


def test_tiff_pages(spark, tmp_path):
    rng = np.random.default_rng(0)
    images = [rng.integers(0, 255, (5, 7)).astype(np.uint8) for _ in range(8)]
    for k in (0, 1):
        tiff.write_pages(str(tmp_path / f"{k}.tif"), images[4 * k : 4 * k + 4], [f"page {n}" for n in range(4)])
    frames = tiff.convert(spark, str(tmp_path / "*.tif"), channel=1, pages_to_channel=2)
    assert {r.t: (r.description, r.data) for r in frames.collect()} == {t: (f"page {2 * t % 4 + 1}", images[2 * t + 1].ravel().tolist()) for t in range(4)}
    about = tiff.read_pages(spark, str(tmp_path / "0.tif"), with_data=False).first()
    assert (about.shape, about.dtype, about.data) == ([5, 7], "uint8", None)
    tiff.write_pages(str(tmp_path / "f.tif"), [np.array([[1.5, -2.0]], np.float32)])
    assert tiff.read_pages(spark, str(tmp_path / "f.tif")).first().data == [1.5, -2.0]


def test_stores(spark, tmp_path):
    kept = store.recorder(spark, str(tmp_path / "a"))
    kept["x"] = spark.range(3)
    assert kept["x"].count() == 3 and "x" in kept and "y" not in kept
    with pytest.raises(KeyError):
        kept["y"]
    with pytest.raises(ValueError):
        kept["z"] = spark.range(0)
    with pytest.raises(Exception, match="EXISTS|exists"):
        kept["x"] = spark.range(4)
    numbered = store.recorder(spark, str(tmp_path / "b"), enumerated=True)
    numbered["x"] = spark.range(3)
    numbered["x"] = spark.range(5)
    assert numbered["x"].count() == 5
    assert not store.recorder(spark, None) and store.recorder(spark, None).get("x") is None
    px = spark.createDataFrame([(t, 0, 0, float(t), t % 2 == 1) for t in range(2500)], "t bigint, y bigint, x bigint, v double, masked boolean")
    store.write_masked(px, str(tmp_path / "m"), -1.0)
    part = store.read_masked(spark, str(tmp_path / "m"), (1000, 1003), filled=True)
    assert sorted(r.v for r in part.collect()) == [-1.0, 1000.0, 1002.0]


def test_configuration(spark, tmp_path):
    tree = {"a": 1, "__comment__x": 2, "b": ["__comment__ y", {"c": "__comment__", "d": 3}]}
    (tmp_path / "c.json").write_text(json.dumps(tree))
    assert config.read_parameters(str(tmp_path / "c.json")) == {"a": 1, "b": [{"d": 3}]}
    assert config.split_store_path("/x/a.h5/b/c") == ("/x/a.h5", "/b/c")
    with pytest.raises(AssertionError):
        config.split_store_path("/x/a.h5")
    with pytest.raises(ValueError):
        config.split_store_path("/x/a.txt/b")
    paths = [(f"/test/{i:03d}/group/{k}/data",) for i in range(0, 101, 5) for k in range(10)][:-1]
    df = spark.createDataFrame(paths, "path string")
    found = config.grouped_paths_found(df, "/test/[0-9]{3}/group/[0-9]/data")
    assert {r.found: r["count"] for r in found.groupBy("found").count().collect()} == {True: 209, False: 1}


def test_synthetic_scenes(spark):
    discs = synthetic.hyperdisc_masks(spark, (9, 9), [(4, 4)], [3], True, [1], True)
    yy, xx = np.mgrid[:9, :9]
    far = np.hypot(yy - 4, xx - 4)
    assert {(r.y, r.x) for r in discs.collect()} == set(zip(*(a.tolist() for a in np.nonzero((far <= 3) & (far >= 1)))))
    total = synthetic.gaussian_images(spark, (15, 15), [(7, 7)], [1.0], [2.0]).agg(F.sum("v")).first()[0]
    assert math.isclose(total, 2.0, rel_tol=1e-6)
    points = synthetic.random_points(spark, (20, 30), [3, 5]).collect()
    assert all(r <= p.y < 20 - r and r <= p.x < 30 - r for p, r in zip(sorted(points), (3, 5)))


def test_streams(spark, noisy, tmp_path):
    stack_of(spark, noisy).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(model.FRAMES).parquet(str(tmp_path / "in"))
    for name, df, mode in (("n", streams.normalized(stream), "append"), ("p", streams.running_projections(stream), "complete")):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        query.processAllAvailable()
        query.stop()
    assert spark.table("n").count() == 6
    assert {(r.y, r.x): r.mx for r in spark.table("p").collect()} == {(y, x): noisy[:, y, x].max() for y in range(7) for x in range(9)}


def reflected(i, n, edge):
    """Index i at the borders of 0..n-1, step by step, the edge repeated or not."""
    while not 0 <= i < n:
        if n == 1:
            return 0
        i = (-i - edge) if i < 0 else 2 * n - 2 + edge - i
    return i


@pytest.mark.parametrize("n", [1, 2, 5])
def test_windows_longer_than_the_axis(spark, n):
    """Linear and rank filters, bands and morphology with half windows up to three times the axis, against plain loops."""
    series = np.random.default_rng(n).random(n)
    table = stack_of(spark, series.reshape(n, 1, 1))
    pixels = model.to_pixels(table)
    for h in sorted({1, n, 2 * n + 1, 3 * n}):
        kernel = {o: 1.0 + abs(o + 1) for o in range(-h, h + 1)}
        taken = np.array([[series[reflected(p + o, n, 0)] for o in range(-h, h + 1)] for p in range(n)])
        found = image_of(filters.axis_filter(pixels, "t", kernel, n), (n, 1, 1)).ravel()
        assert np.allclose(found, taken @ [kernel[o] for o in range(-h, h + 1)])
        held = np.array([[series[min(max(p + o, 0), n - 1)] for o in range(-h, h + 1)] for p in range(n)])
        found = image_of(filters.axis_filter(pixels, "t", kernel, n, border="nearest"), (n, 1, 1)).ravel()
        assert np.allclose(found, held @ [kernel[o] for o in range(-h, h + 1)])
        found = image_of(filters.rank_filter(pixels, h, 0.9, n), (n, 1, 1)).ravel()
        assert np.array_equal(found, np.sort(taken, axis=1)[:, round(0.9 * 2 * h)])
        mask = pixels.filter("v > 0.5").select(F.lit(0).cast("bigint").alias("t"), F.col("t").alias("y"), "x")
        reached = [(0, d) for d in (-h, 0, h)]
        found = {r.x for r in filters.binary_dilation(mask.select("t", F.lit(0).cast("bigint").alias("y"), F.col("y").alias("x")), reached, (1, n)).collect()}
        assert found == {p for p in range(n) if any(series[reflected(p + d, n, 1)] > 0.5 for _, d in reached)}


def test_bands_add_up_at_any_scale(spark):
    """Constant frames have no detail; four levels along short axes, against plain loops."""
    images = np.random.default_rng(8).random((3, 4, 5))
    found = filters.wavelet_transform(model.to_pixels(stack_of(spark, images)), {"t": 4, "x": 3}, {"t": 3, "x": 5}, include_lower_scales=True)
    current = images
    for level in range(1, 5):
        smooth = current
        for axis, last in ((0, 4), (2, 3)):
            if level <= last:
                n, kernel = images.shape[axis], filters.binomial_kernel(level)
                smooth = np.stack([sum(w * np.take(smooth, reflected(p + o, n, 0), axis) for o, w in kernel.items()) for p in range(n)], axis)
        assert np.allclose(image_of(found.filter(F.col("band") == level).drop("band"), images.shape), current - smooth)
        current = smooth
    flat = filters.wavelet_transform(model.to_pixels(stack_of(spark, np.ones((3, 4, 5)))), 3, {"t": 3, "y": 4, "x": 5})
    assert flat.agg(F.max(F.abs("v"))).first()[0] < 1e-12


def test_images_hold_the_edge(spark):
    """A point beside the border: what the kernel would put outside stays with the edge."""
    found = image_of(synthetic.gaussian_images(spark, (9, 9), [(0, 8)], [1.5], [1.0]), (1, 9, 9))
    kernel = filters.gaussian_kernel(1.5, 4.0)
    def line(at):
        return np.array([sum(w for o, w in kernel.items() if min(max(p + o, 0), 8) == at) for p in range(9)])
    assert np.allclose(found[0], np.outer(line(0), line(8)))


def test_chains_merge_to_the_end(spark):
    """A chain of neurons, each like the next, becomes one in as many rounds as it takes."""
    rows = [(0, k, [(0, x, 1.0) for x in range(k, k + 20)]) for k in range(14)]
    found = spark.createDataFrame(rows, "t bigint, label bigint, pixels array<struct<y bigint, x bigint, v double>>")
    left = neurons.merge_neuron_sets(found, (1, 40), 0.9, 2.0).select("neuron", "pixels").collect()
    cells = spark.createDataFrame([(r.neuron, p.y, p.x, p.v) for r in left for p in r.pixels], "neuron bigint, y bigint, x bigint, v double")
    assert len(left) < 14 and neurons.similarities(cells).filter("angle > 0.9").isEmpty()


def test_spatial_window_of_its_own(spark):
    images = np.random.default_rng(3).random((4, 9, 8))
    sizes = dict(zip("tyx", images.shape))
    options = {"half_window_size": 1, "which_quantile": 0.5, "spatial_stdev": 1.5}
    stack = model.to_pixels(stack_of(spark, images))
    both = image_of(traces.estimate_f0(stack, sizes=sizes, window_size=1.0, **options), images.shape)
    own = image_of(traces.estimate_f0(stack, sizes=sizes, window_size=5.0, spatial_window_size=1.0, **options), images.shape)
    wide = image_of(traces.estimate_f0(stack, sizes=sizes, window_size=5.0, **options), images.shape)
    assert np.allclose(both, own) and not np.allclose(own, wide)
