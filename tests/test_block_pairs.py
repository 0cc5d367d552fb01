import numpy as np

from lumenstack.operators import blocks, pairwise

VECTORS, MASKS = "id bigint, v array<double>", "i bigint, y bigint, x bigint"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_products_over_a_bar_are_those_of_all_pairs(spark, monkeypatch):
    """Many blocks, and a block for all, against the pairs made one by one; zeros, repeated ids and lengths that differ give NaN."""
    rng = np.random.default_rng(3)
    rows = [(int(k) - 40, [float(x) for x in rng.normal(size=5)]) for k in range(90)] + [(200, [0.0] * 5), (201, [1.0, 2.0]), (202, [2.0, 4.0])]
    v = spark.createDataFrame(rows, VECTORS)
    for least in (7, 1000):
        monkeypatch.setattr(blocks, "LEAST_ROWS", least)
        whole = {(r.i, r.j): r.value for r in pairwise.dot_product_normalized(v, v).collect() if r.i < r.j and not r.value <= 0.4}
        found = pairwise.products_over(v, None, 0.4).collect()
        assert len(found) == len(whole) and len(whole) > 300
        assert all(str(whole[r.i, r.j]) == str(r.value) for r in found)
        two = pairwise.products_over(v.filter("id < 0"), v, 0.4).collect()
        assert {(r.i, r.j) for r in two} == {(r.i, r.j) for r in pairwise.dot_product_normalized(v.filter("id < 0"), v).collect() if not r.value <= 0.4}


def test_masks_by_blocks(spark, monkeypatch):
    """Against sets; a pixel without a coordinate counts in the area only."""
    rng = np.random.default_rng(4)
    sets = {int(k): {(int(y), int(x)) for y, x in rng.integers(0, 12, (rng.integers(1, 12), 2))} for k in range(60)}
    rows = [(k, y, x) for k, s in sets.items() for y, x in s] + [(3, None, 2)]
    m = spark.createDataFrame(rows, MASKS)
    sets[3].add((None, 2))
    wanted = sorted((i, j, n, len(sets[i] | sets[j]), n / len(sets[i] | sets[j])) for i in sets for j in sets if i < j and (n := len(sets[i] & sets[j])))
    for least in (5, 1000):
        monkeypatch.setattr(blocks, "LEAST_ROWS", least)
        assert rows_of(pairwise.masks_overlap(m, None)) == wanted
        both = rows_of(pairwise.masks_overlap(m, m.withColumnRenamed("i", "j")))
        assert [r for r in both if r[0] < r[1]] == wanted and len(both) == 2 * len(wanted) + len(sets)


def test_strips_of_a_block(monkeypatch):
    """The same pairs, in whatever strips of rows and of positions they are made."""
    rng = np.random.default_rng(5)
    ids, data = np.arange(40), rng.normal(size=(40, 3))
    block = {"width": 3, "ids": ids.tobytes(), "data": data.tobytes(), "norms": np.sqrt((data**2).sum(1)).tobytes()}
    at = rng.integers(0, 6, (200, 2))
    row = rng.integers(0, 40, 200)
    masks = {"ids": ids.tobytes(), "areas": np.bincount(row, minlength=40).tobytes(), "rows": row.tobytes(), "at": at.tobytes()}
    found = []
    for strip in (90, 2_000_000):
        monkeypatch.setattr(blocks, "STRIP", strip)
        found.append([sorted(tuple(r.values()) for b in made for r in b.to_pylist()) for made in (
            list(blocks.products_above(block, block, True, 0.4, True)), list(blocks.overlaps(masks, masks, True, True, 2, list("ijnuo"))), list(blocks.overlaps(masks, masks, False, False, 2, list("ijnuo"))))])
    assert found[0] == found[1] and all(found[0])


def test_no_rows(spark):
    assert pairwise.products_over(spark.createDataFrame([], VECTORS), None, 0.4).count() == 0
    assert pairwise.masks_overlap(spark.createDataFrame([], MASKS), None).count() == 0


def test_the_plan_makes_no_pair_of_rows(spark, sf_dir):
    """All pairs come from blocks: what is joined are rows of blocks, of which there are few."""
    from lumenstack.plans import registry

    for name in ("dot_product_normalized", "masks_overlap"):
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "block_a" in plan and "zip_with" not in plan
