import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lumenstack.llm import simhash
from lumenstack.llm.components import connected_components


def brute_print(text, words=3):
    found = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
    shingles = [b" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or ([b" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    """prints: (id, fingerprint) rows; the least id reachable for each."""
    name = {i: i for i, _ in prints if i is not None}
    changed = True
    while changed:
        changed = False
        for i, a in prints:
            for j, b in prints:
                if None not in (i, j) and (a ^ b).bit_count() <= radius and name[j] < name[i]:
                    name[i], changed = name[j], True
    return name


def test_components_and_prints(documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    prints = {i: brute_print(t) for i, t in texts.items()}
    rows = simhash.near_duplicates(documents).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == brute_components(list(prints.items()), 2)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 90).astype(np.uint64)
    values = np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 90).astype(np.uint64)) for _ in range(3)])
    got = {(int(q), int(v)) for a, b in simhash.within_radius(values, simhash.bit_planes(values), radius, block=2) for q, v in zip(a, b) if v < len(values)}
    assert got == {(i, j) for i, x in enumerate(values) for j, y in enumerate(values) if int(x ^ y).bit_count() <= radius}


def test_links_across_batches(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(63) for _ in range(40)]
    rows = [(b ^ (1 << rng.randrange(62)) if k else b, 10 * i + k) for i, b in enumerate(base) for k in range(4)]
    rows = list({fp: (fp, node) for fp, node in rows}.values())
    edges = simhash.link_edges(spark.createDataFrame(rows, "fp bigint, node bigint"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = {r.node: r.component for r in connected_components(edges).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = brute_components([(node, fp) for fp, node in rows], 2)
    assert all(found.get(node, node) == name for node, name in expected.items())


def test_long_runs_of_hashes():
    hashes = np.full(140_000, 5, np.uint64)
    assert simhash.majority_bits(np.r_[hashes, np.zeros(0, np.uint64)], np.array([0, 0, 140_000])).tolist() == [0, 5]


def test_odd_rows(odd_rows, empty):
    rows = simhash.near_duplicates(odd_rows).collect()
    assert len(rows) == odd_rows.count()
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert {r.fingerprint for r in rows if r.doc_id in (1, 2, 3)} == {"0" * 16}
    assert {r.component_id for r in rows if r.doc_id in (7, 8, None)} == {7}
    assert simhash.near_duplicates(empty).count() == 0


def test_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(300, 400)] + [(5, 5), (None, 3), (2, 1), (1, 2)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(300, 400)}, 7: 7, 1: 1, 2: 1}
