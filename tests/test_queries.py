"""Every query against its SQL in DuckDB, over the smallest tables."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from lumenstack.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf_dir)
    cursor = con.execute(registry.ORACLES[name])
    names = [d[0] for d in cursor.description]
    expected = Counter(tuple(plain(r[names.index(c)]) for c in df.columns) for r in cursor.fetchall())
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(map(plain, r)) for r in df.collect()) == expected
    assert expected


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_others_run(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def embedded(sf_dir):
    con = duckdb.connect()
    rows = con.execute(f"select vec_id, embedding::double[] from '{sf_dir}/embeddings.parquet' order by vec_id").fetchall()
    return [r[0] for r in rows], np.array([r[1] for r in rows]).reshape(-1, 8, 8)


def test_register_mean_offsets_by_replay(spark, sf_dir):
    """Three rounds of the same rule in numpy, frame by frame."""
    times, images = embedded(sf_dir)
    shifts = np.zeros((len(images), 2), int)
    for _ in range(3):
        mean = np.mean([np.roll(f, s, (0, 1)) for f, s in zip(images, shifts)], axis=0)
        new = []
        for f in images:
            score = [[abs((np.roll(f, (-dy, -dx), (0, 1)) * mean).sum()) for dx in range(8)] for dy in range(8)]
            new.append(np.unravel_index(np.argmax(np.round(score, 12)), (8, 8)))
        raw = -np.array(new)
        centred = raw - np.round(raw.mean(axis=0)).astype(int)
        once = np.where(centred > 4, centred - 8, centred)
        shifts = np.where(once < -4, once + 8, once)
    found = registry.QUERIES["register_mean_offsets"](spark, sf_dir).collect()
    assert {r.t: (r.dy, r.dx) for r in found} == {t: tuple(map(int, s)) for t, s in zip(times, shifts)}
