"""Three-dimensional stacks: labels by slabs, properties, maxima, flooding, synthetic scenes and denoising."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenstack import model
from lumenstack.operators import components, filters, neurons, regions, segmentation, synthetic


def volumes_of(spark, images):
    images = np.asarray(images, float)
    return spark.createDataFrame([(t, list(v.shape), v.ravel().tolist()) for t, v in enumerate(images)], model.FRAMES)


def dense(pixels, shape, value="v", fill=np.nan):
    out = np.full(shape, fill)
    for r in pixels.collect():
        out[r.t, r.z, r.y, r.x] = r[value]
    return out


def flood(mask, around):
    """Labels by a search from each pixel in scan order."""
    out, label = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask)):
        if out[start]:
            continue
        label += 1
        out[start], todo = label, [start]
        while todo:
            p = todo.pop()
            for o in around:
                q = tuple(a + b for a, b in zip(p, o))
                if all(0 <= a < n for a, n in zip(q, mask.shape)) and mask[q] and not out[q]:
                    out[q] = label
                    todo.append(q)
    return out


@pytest.fixture(scope="module")
def cloud():
    return np.random.default_rng(4).random((3, 7, 6, 5))


def test_forms_round_trip(spark, cloud):
    px = model.to_pixels(volumes_of(spark, cloud), 3)
    assert np.array_equal(dense(px, cloud.shape), cloud)
    assert {r.t: r.data for r in model.to_frames(px, (7, 6, 5)).collect()} == {t: v.ravel().tolist() for t, v in enumerate(cloud)}
    planes = {(r.t, r.z): (r.shape, r.data) for r in regions.to_planes(volumes_of(spark, cloud)).collect()}
    assert planes == {(t, z): ([6, 5], p.ravel().tolist()) for t, v in enumerate(cloud) for z, p in enumerate(v)}


@pytest.mark.parametrize("depth", [1, 2, 3, 16])
@pytest.mark.parametrize("connectivity", [6, 26])
def test_labels_by_slabs(spark, cloud, depth, connectivity):
    threshold = 0.62 if connectivity == 6 else 0.85
    expected = np.array([flood(v > threshold, regions.neighbours(3, connectivity)) for v in cloud])
    assert max(np.bincount(expected[0].ravel())[1:]) > 5
    planes = regions.to_planes(volumes_of(spark, cloud))
    found = dense(regions.label_planes(planes, threshold, depth, connectivity), cloud.shape, "label", 0)
    assert np.array_equal(found, expected)
    whole = dense(regions.label_components(volumes_of(spark, cloud), threshold, connectivity, 3), cloud.shape, "label", 0)
    assert np.array_equal(whole, expected)


def test_planes_that_are_absent_part_what_they_held(spark):
    ones = regions.to_planes(volumes_of(spark, np.ones((1, 6, 2, 2))))
    found = regions.label_planes(ones.filter("z <> 3"), 0.5, depth=2)
    assert {(r.z, r.label) for r in found.collect()} == {(0, 1), (1, 1), (2, 1), (4, 2), (5, 2)}
    assert regions.label_planes(ones, 2.0).count() == 0


def test_components_of_long_chains_and_hubs(spark):
    rng = np.random.default_rng(0)
    names = rng.permutation(400).tolist()
    edges = [(names[k], names[k + 1]) for k in range(199)] + [(names[200], names[k]) for k in range(201, 300)] + [(names[300], names[300]), (None, 5)]
    found = {r.node: r.root for r in components.unite(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    expected = {names[k]: min(names[:200]) for k in range(200)} | {names[k]: min(names[200:300]) for k in range(200, 300)} | {names[300]: names[300]}
    assert found == expected


def test_properties_of_volumes(spark):
    mask = np.zeros((1, 9, 9, 9))
    mask[0, 1:8, 2:5, 3:5] = 1.0
    cells = regions.label_components(volumes_of(spark, mask), 0.5, 6, 3)
    row = regions.region_properties(cells, ["t", "label"]).first()
    at = np.argwhere(mask[0])
    values = np.linalg.eigvalsh(np.cov(at.T, bias=True))
    assert (row.area, row.cz, row.cy, row.cx) == (42, 4.0, 3.0, 3.5) and math.isclose(row.extent, 1.0)
    assert math.isclose(row.major_axis_length, 4 * values[-1] ** 0.5) and math.isclose(row.minor_axis_length, 4 * values[0] ** 0.5)
    assert math.isclose(row.eccentricity, (1 - values[0] / values[-1]) ** 0.5)
    skew = np.random.default_rng(2).random((1, 6, 6, 6)) * np.ones((1, 6, 6, 6))
    found = {r.label: r for r in regions.region_properties(regions.label_components(volumes_of(spark, skew), 0.7, 6, 3), ["t", "label"]).collect()}
    labels = flood(skew[0] > 0.7, regions.neighbours(3, 6))
    for k, r in found.items():
        values = np.linalg.eigvalsh(np.cov(np.argwhere(labels == k).T, bias=True)) if r.area > 1 else np.zeros(3)
        assert np.allclose([r.major_axis_length, r.minor_axis_length], [4 * max(values[-1], 0) ** 0.5, 4 * max(values[0], 0) ** 0.5], atol=1e-6)


def test_maxima_of_volumes(spark, cloud):
    stack = volumes_of(spark, cloud)
    peaks = {(r.t, r.z, r.y, r.x) for r in regions.extended_local_maxima(stack, 3).collect()}
    near = {(r.t, r.z, r.y, r.x) for r in regions.local_maxima(model.to_pixels(stack, 3)).collect()}
    padded = np.pad(cloud, ((0, 0), (1, 1), (1, 1), (1, 1)), constant_values=-1)
    expected = {p for p in np.ndindex(cloud.shape) if cloud[p] == padded[p[0], p[1] : p[1] + 3, p[2] : p[2] + 3, p[3] : p[3] + 3].max()}
    assert peaks == near == expected
    table = spark.createDataFrame([(0, 0, 0, 0, 1.0), (0, 2, 1, 0, 2.0), (0, 6, 6, 6, 1.0), (0, 6, 6, 9, 1.0)], "t bigint, z bigint, y bigint, x bigint, v double")
    assert {(r.z, r.y, r.x) for r in regions.remove_too_close_local_maxima(table, 3.0, ["t"]).collect()} == {(2, 1, 0), (6, 6, 6), (6, 6, 9)}


def test_watershed_of_a_volume():
    image, markers = np.ones((3, 3, 5)), np.zeros((3, 3, 5), int)
    image[:, :, 2] = 5
    markers[1, 1, 0], markers[1, 1, 4] = 1, 2
    found = regions.watershed(image, markers, np.ones(image.shape, bool))
    assert (found[..., :2] == 1).all() and (found[..., 3:] == 2).all() and (found > 0).all()


def test_synthetic_volumes(spark):
    found = synthetic.hyperdisc_masks(spark, (7, 8, 9), [(3, 4, 4)], [3], True, [1], True)
    at = np.indices((7, 8, 9))
    far = np.sqrt(sum((a - c) ** 2 for a, c in zip(at, (3, 4, 4))))
    assert {(r.z, r.y, r.x) for r in found.collect()} == set(zip(*(a.tolist() for a in np.nonzero((far <= 3) & (far >= 1)))))
    image = synthetic.gaussian_images(spark, (11, 11, 11), [(5, 5, 5)], [0.8], [2.0])
    assert math.isclose(image.agg(F.sum("v")).first()[0], 2.0, rel_tol=1e-6) and image.orderBy(F.desc("v")).first()[:4] == (0, 5, 5, 5)
    points = synthetic.random_points(spark, (20, 30, 25), [3, 5]).collect()
    assert all(r <= p.z < 20 - r and r <= p.y < 30 - r and r <= p.x < 25 - r for p, r in zip(sorted(points), (3, 5)))


def test_contour_of_a_ball(spark):
    ball = synthetic.hypersphere_masks(spark, (9, 9, 9), [(4, 4, 4)], [3.5])
    solid = np.zeros((9, 9, 9), bool)
    for r in ball.collect():
        solid[r.z, r.y, r.x] = True
    edge = {(r.z, r.y, r.x) for r in regions.contour(ball, (9, 9, 9), ["k"]).collect()}
    inner = np.logical_and.reduce([regions.shifted(solid, o, False) for o in regions.neighbours(3, 6)])
    assert edge == set(zip(*(a.tolist() for a in np.nonzero(solid & ~inner))))


def test_wavelets_where_frames_lie(spark, cloud):
    """All bands and intermediates of a volume, against the filter over pixels, along axes with scales of their own."""
    stack = volumes_of(spark, cloud)
    scale = {"z": 1, "y": 3, "x": 2}
    found = filters.frame_wavelets(stack, scale, 3, include_intermediates=True)
    plain = filters.wavelet_transform(model.to_pixels(stack, 3), scale, {"z": 7, "y": 6, "x": 5}, include_intermediates=True)
    for band in (1, 2, 3):
        own = {r.t: r for r in found.filter(F.col("band") == band).collect()}
        other = plain.filter(F.col("band") == band)
        for column, name in (("data", "v"), ("smooth", "smooth")):
            assert np.allclose([np.reshape(own[t][column], cloud.shape[1:]) for t in range(3)], dense(other, cloud.shape, name))
    last = {r.t: r.data for r in filters.frame_wavelets(stack, scale, 3).collect()}
    assert last == {r.t: r.data for r in found.filter("band = 3").collect()}


def test_denoising_a_volume(spark):
    """Two balls in one volume and one in another are found as neurons at their centres."""
    at = np.indices((22, 24, 26))
    centres = [[(6, 7, 6), (15, 16, 18)], [(11, 9, 13)]]
    images = np.array([sum(12 * np.exp(-sum((a - c) ** 2 for a, c in zip(at, p)) / 8.0) for p in own) for own in centres])
    found = segmentation.wavelet_denoising(model.to_pixels(volumes_of(spark, images), 3), (22, 24, 26), wavelet_scale=2, noise_threshold=3.0, accepted_neuron_shape_constraints={"area": {"min": 20, "max": 3000}})
    rows = found.collect()
    assert {(r.t, *(round(c) for c in r.centroid)) for r in rows} == {(t, *p) for t, own in enumerate(centres) for p in own}
    assert all(len(r.gaussian_cov) == 3 and len(r.gaussian_cov[0]) == 3 for r in rows)
    merged = neurons.merge_neuron_sets(found, (22, 24, 26), 0.6, 0.6)
    assert merged.count() == 3
    record = neurons.neuron_records(merged, (22, 24, 26)).first()
    assert sum(record.mask) == record.area and record.shape == [22, 24, 26] and max(record.image) == record.max_F
