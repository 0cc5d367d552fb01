import numpy as np
import pytest

from lumenstack.llm import epsilon_grid


def brute(rows, least):
    def fine(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    ok = [(i, np.array(v, np.float32).astype(float), label) for i, v, label in rows if label is not None and fine(v)]
    links = {i: set() for i, _, _ in rows}
    for a, (i, v, x) in enumerate(ok):
        for j, w, y in ok[:a]:
            if x == y and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= least:
                links[i].add(j)
                links[j].add(i)
    name = {i: i for i in links}
    for _ in links:
        name = {i: min([name[i], *(name[j] for j in links[i])]) for i in links}
    return {i: (len(links[i]), name[i], name[i] == i) for i in links}


def result(df, **options):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in epsilon_grid.near_duplicates(df, **options).collect()}


@pytest.mark.parametrize("least", [0.98, 0.8])
def test_against_all_pairs(spark, least):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 10))
    rows = [(k, (centres[k % 12] + rng.normal(size=10) * rng.choice([0.02, 0.2, 0.5])).tolist(), int(k % 3)) for k in range(300)]
    rows += [(300 + k, rows[0][1], 0) for k in range(40)] + [(400, [-x for x in rows[0][1]], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    assert result(df, least=least) == brute(rows, least)


def test_given_vectors(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert result(df) == brute([(r.vec_id, r.embedding, r.label) for r in df.collect()], 0.98)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], None)]
    rows += [(9, [1.0, 0.0], 2), (10, [2.0, 0.0], 2), (11, [1e-30, 0.0], 2), (12, [1.0, 0.0, 0.0], 2), (13, [1.0, 0.0], 3)]
    schema = "vec_id bigint, embedding array<float>, label int"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 as node", "'x' as v")
    assert result(df) == brute(rows, 0.98)
    assert result(spark.createDataFrame([], schema)) == {}
