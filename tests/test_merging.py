"""Merging of neurons in order, against a plain replay of the rule on dense images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenstack import model
from lumenstack.operators import neurons, regions
from lumenstack.plans import registry

FOUND = "t bigint, label bigint, pixels array<struct<y bigint, x bigint, v double>>"


def fused(a, b, fraction):
    mean = (a["image"] + b["image"]) / 2
    mask = mean > fraction * mean.max()
    return {"image": mean * mask, "mask": mask}


def replay(items, alignment, overlap, fraction, survive=False):
    """The rule, a matrix at a time: items are dicts of dense images and masks, in order."""
    items = [dict(i) for i in items]
    before = 0
    while len(items) > 1 and before != len(items):
        before = n = len(items)
        angle, share = np.zeros((n, n)), np.zeros((n, n))
        for i in range(n):
            for j in range(n):
                a, b = items[i], items[j]
                norms = np.linalg.norm(a["image"]) * np.linalg.norm(b["image"])
                if i < j and norms:
                    angle[i, j] = round(float((a["image"] * b["image"]).sum() / norms), 12)
                if i != j and a["mask"].any():
                    share[i, j] = round(float((a["mask"] & b["mask"]).sum() / a["mask"].sum()), 12)
        targets, matched = {}, set()
        for j in range(n):
            if angle[:, j].max() > alignment:
                targets[j] = int(angle[:, j].argmax())
        matched = set(targets) | set(targets.values())
        for j in range(n):
            if j not in matched and share[:, j].max() > overlap:
                targets[j] = int(share[:, j].argmax())
        gone = {}
        for j in sorted(targets):
            i = targets[j]
            while survive and i in gone:
                i = gone[i]
            if i == j:
                continue
            items[i] = fused(items[i], items[j], fraction)
            gone[j] = i
        items = [x for k, x in enumerate(items) if k not in gone]
    return items


def dense(rows, shape):
    out = []
    for pixels in rows:
        image, mask = np.zeros(shape), np.zeros(shape, bool)
        for y, x, v in pixels:
            image[y, x], mask[y, x] = v, True
        out.append({"image": image, "mask": mask})
    return out


def same(found, expected, shape):
    rows = sorted(found.collect(), key=lambda r: r.neuron)
    got = dense([[tuple(p) for p in r.pixels] for r in rows], shape)
    expected = [e for e in expected if e["mask"].any()]
    assert len(got) == len(expected)
    for g, e in zip(got, expected):
        assert np.array_equal(g["mask"], e["mask"]) and np.allclose(g["image"], e["image"])


def scattered(seed, n=40, shape=(12, 12)):
    """Boxes of any size and value, many alike."""
    rng, rows = np.random.default_rng(seed), []
    for k in range(n):
        y, x = (int(rng.integers(0, s - 2)) for s in shape)
        h, w = (int(v) for v in rng.integers(1, 6, 2))
        level = float(rng.integers(1, 4))
        rows.append((int(rng.integers(0, 6)), k, [(a, b, level + (0.1 * float(rng.integers(0, 3)))) for a in range(y, min(y + h, shape[0])) for b in range(x, min(x + w, shape[1]))]))
    return rows


def sparse(items):
    return {k: (np.flatnonzero(x["mask"]), x["image"].ravel()[np.flatnonzero(x["mask"])]) for k, x in enumerate(items)}


@pytest.mark.parametrize("chains", ["reference", "survive"])
@pytest.mark.parametrize("thresholds", [(0.6, 0.6), (0.9, 0.5), (2.0, 0.6), (0.3, 0.3)])
def test_rule_by_replay(chains, thresholds):
    """What a task does to a cluster, on scattered boxes, against the replay."""
    for seed in range(8):
        items = dense([r[2] for r in scattered(seed)], (12, 12))
        expected = replay(items, *thresholds, 0.01, chains == "survive")
        found = neurons.merged(sparse(items), 144, *thresholds, 0.01, chains)
        assert len(found) == len(expected)
        for (pix, val), e in zip((found[k] for k in sorted(found)), expected):
            assert np.array_equal(pix, np.flatnonzero(e["mask"])) and np.allclose(val, e["image"].ravel()[pix])


@pytest.mark.parametrize("cells, chains", [(0, "reference"), (neurons.CLUSTER_CELLS, "survive")])
def test_tables_by_replay(spark, cells, chains):
    """Clusters in one task each, and in rounds over the table."""
    rows = scattered(16, 20 if cells == 0 else 40)
    found = neurons.merge_neuron_sets(spark.createDataFrame(rows, FOUND).repartition(3), (12, 12), 0.7, 0.5, chains=chains, cluster_cells=cells)
    ordered = dense([r[2] for r in sorted(rows, key=lambda r: r[:2])], (12, 12))
    same(found, replay(ordered, 0.7, 0.5, 0.01, chains == "survive"), (12, 12))


@pytest.mark.parametrize("cells", [0, neurons.CLUSTER_CELLS])
def test_sets_one_after_another(spark, cells):
    rows = [(t % 2 if cells == 0 else t, k, pixels) for t, k, pixels in scattered(3, 14 if cells == 0 else 24)]
    found = neurons.merge_neuron_sets(spark.createDataFrame(rows, FOUND), (12, 12), 0.7, 0.6, step="t", cluster_cells=cells)
    current = []
    for t in sorted({r[0] for r in rows}):
        current = replay(current + dense([r[2] for r in sorted(rows, key=lambda r: r[:2]) if r[0] == t], (12, 12)), 0.7, 0.6, 0.01, True)
    same(found, current, (12, 12))


def test_images_apart(spark):
    """What lies in different images never meets, though it is the same."""
    rows = [(stack, k, [(0, x, 1.0 + stack) for x in range(k, k + 4)]) for stack in (0, 1) for k in (0, 1)]
    table = spark.createDataFrame(rows, FOUND).withColumn("stack", F.col("t"))
    found = neurons.merge_neuron_sets(table, (3, 6), 0.7, 0.6, apart="stack").orderBy("stack").collect()
    assert [(r.stack, r.neuron, r.max_F, sorted((p.y, p.x) for p in r.pixels)) for r in found] == [(k, 2 * k, 1.0 + k, [(0, x) for x in range(5)]) for k in (0, 1)]


def test_small_inside_large_whatever_the_order():
    small, large = (np.arange(3), np.ones(3)), (np.arange(30), np.ones(30))
    for items in ({0: small, 1: large}, {0: large, 1: small}):
        assert len(neurons.merged(items, 72, 0.9, 0.9, 0.01, "survive")) == len(neurons.merged(items, 72, 0.9, 0.9, 0.01, "reference")) == 1


def test_means_of_pairs_in_order():
    items = {k: (np.arange(2), np.full(2, v)) for k, v in enumerate((1.0, 2.0, 9.0))}
    for chains in ("survive", "reference"):
        found = neurons.merged(items, 4, 0.9, 0.9, 0.01, chains)
        assert list(found) == [0] and found[0][1].tolist() == [5.25, 5.25]


def test_masks_that_hold_each_other():
    """Both hold most of the other without being alike: one stays, unless the reference's chains are asked for."""
    one, other = np.where(np.arange(10) < 2, 1.0, 9.0), np.where(np.arange(10) < 2, 9.0, 0.1)
    items = {0: (np.arange(10), one), 1: (np.arange(10), other)}
    assert len(neurons.merged(items, 24, 0.95, 0.6, 0.01, "survive")) == 1
    assert len(neurons.merged(items, 24, 0.95, 0.6, 0.01, "reference")) == 0


def test_discs(spark):
    """Two discs apart stay as they are; a set merged with itself is the set."""
    at = np.indices((100, 100))
    discs = [np.hypot(at[0] - c, at[1] - c) < 25 for c in (25, 74)]
    rows = [(0, k, [(int(y), int(x), 5.0) for y, x in np.argwhere(d)]) for k, d in enumerate(discs)]
    table = spark.createDataFrame(rows, FOUND)
    apart = neurons.merge_neuron_sets(table, (100, 100), 0.6, 0.6)
    same(apart, dense([r[2] for r in rows], (100, 100)), (100, 100))
    doubled = table.withColumn("set", F.lit(0)).unionByName(table.withColumn("set", F.lit(1)))
    same(neurons.merge_neuron_sets(doubled, (100, 100), 0.6, 0.6), dense([r[2] for r in rows], (100, 100)), (100, 100))
    assert sorted(r.area for r in apart.collect()) == sorted(float(d.sum()) for d in discs)
    row = apart.orderBy("neuron").first()
    points = np.argwhere(discs[0])
    assert np.allclose(row.centroid, points.mean(0)) and np.allclose(row.gaussian_cov, np.cov(points.T)) and row.max_F == 5.0


@pytest.mark.parametrize("seed", [1])
def test_once_by_brute_force(spark, seed):
    rows = scattered(seed, 36)
    sets = [[r for r in sorted(rows, key=lambda r: r[:2]) if r[1] % 2 == k] for k in (0, 1)]
    one, two = (dense([r[2] for r in s], (12, 12)) for s in sets)
    out, added = [dict(a) for a in one], []
    for b in two:
        angle, mine, yours = [], [], []
        for a in one:
            norms = np.linalg.norm(a["image"]) * np.linalg.norm(b["image"])
            common = (a["mask"] & b["mask"]).sum()
            angle.append(round(float((a["image"] * b["image"]).sum() / norms), 12))
            mine.append(round(float(common / a["mask"].sum()), 12))
            yours.append(round(float(common / b["mask"].sum()), 12))
        if max(angle) > 0.7:
            i = int(np.argmax(angle))
        elif max(yours) > 0.6:
            i = int(np.argmax(mine))
        elif max(mine) > 0.6:
            i = int(np.argmax(yours))
        else:
            added.append(b)
            continue
        out[i] = fused(one[i], b, 0.01)
    tables = [spark.createDataFrame(s, FOUND).repartition(2) for s in sets]
    found = neurons.merge_neuron_sets_once(*tables, (12, 12), 0.7, 0.6)
    same(found, out + added, (12, 12))
    assert [r.neuron for r in found.orderBy("neuron").collect()] == list(range(len(out) + len(added)))
    for empty in (0, 1):
        pair = [t.limit(0) if k == empty else t for k, t in enumerate(tables)]
        same(neurons.merge_neuron_sets_once(*pair, (12, 12), 0.7, 0.6), two if empty == 0 else one, (12, 12))


def test_negative_thresholds_and_unknown_chains(spark):
    table = spark.createDataFrame([], FOUND)
    with pytest.raises(ValueError):
        neurons.merge_neuron_sets(table, (2, 2), -0.1, 0.5)
    with pytest.raises(ValueError):
        neurons.merge_neuron_sets(table, (2, 2), 0.1, 0.5, chains="any")
    assert neurons.merge_neuron_sets(table, (2, 2), 0.5, 0.5).count() == 0


def test_queries_by_replay(spark, sf_dir):
    """The registered queries against the replay over the whole table."""
    found = neurons.extract_neurons(regions.label_components(registry.frames(spark, sf_dir), 0.25), ["t", "label"])
    rows = sorted(((r.t, r.label, [tuple(p) for p in r.pixels]) for r in found.collect()), key=lambda r: r[:2])
    expected = replay(dense([r[2] for r in rows], (8, 8)), 0.9, 0.9, 0.01)
    got = registry.QUERIES["merge_neurons"](spark, sf_dir).orderBy("neuron").collect()
    assert [(r.area, r.max_f) for r in got] == [(e["mask"].sum(), pytest.approx(e["image"].max(), abs=1e-6)) for e in expected]


def test_records(spark):
    mask = np.zeros((5, 6), bool)
    mask[1:4, 1:5] = True
    image = np.arange(30.0).reshape(5, 6)
    row = neurons.one_neuron(spark, mask, image).first()
    assert np.array_equal(np.reshape(row.mask, (5, 6)), mask) and np.array_equal(np.reshape(row.image, (5, 6)), image * mask)
    edge = mask.copy()
    edge[2, 2:4] = False
    assert np.array_equal(np.reshape(row.contour, (5, 6)), edge)
    assert (row.area, row.max_F, row.shape) == (12.0, 22.0, [5, 6]) and np.allclose(row.gaussian_cov, np.cov(np.argwhere(mask).T))
    assert neurons.empty_neurons(spark).count() == 0 and neurons.empty_neurons(spark).schema == model.neuron_schema()
