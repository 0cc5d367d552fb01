import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from lumenstack.llm import lexical
from lumenstack.llm.queries import ORACLES, op12_ranked_search


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(lexical.UPPER, lexical.LOWER)))


def exact(docs, items, k=10):
    """(item, rank, doc, score) of all documents scored in turn."""
    held = [(doc_id, Counter(words(text))) for doc_id, text in docs if words(text)]
    n_all, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(words(text))
    out = []
    for item, terms in wanted.items():
        scores = []
        for doc_id, c in held:
            m = 10 + 90 * sum(c.values()) * n_all // n_terms
            scores.append((sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c), doc_id))
        best = sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]
        out += [(item, r + 1, doc_id, score) for r, (score, doc_id) in enumerate(best)]
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    assert got(op12_ranked_search(spark, sf_dir)) == sorted(con.execute(ORACLES["op12_ranked_search"]).fetchall(), key=str)


@pytest.mark.parametrize("postings, slice_bytes, share", [(500, 8 << 20, 16), (2_000_000, 2000, 16), (3000, 8 << 20, 2), (3000, 8 << 20, 10**9)])
def test_blocks_slices_and_short_lists(spark, sf_dir, documents, monkeypatch, postings, slice_bytes, share):
    for name, value in (("BLOCK_POSTINGS", postings), ("SLICE_BYTES", slice_bytes), ("SHORT_SHARE", share), ("BATCH_BYTES", 50_000)):
        monkeypatch.setattr(lexical, name, value)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    expected = exact([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got(lexical.rank_documents(documents, items)) == expected


def test_search_of_a_block_by_brute_force():
    rng, skipped = np.random.default_rng(5), 0
    for trial in range(60):
        n = int(rng.integers(1, 400))
        lists = []
        for _ in range(int(rng.integers(0, 9))):
            docs = np.flatnonzero(rng.random(n) < rng.choice([0.01, 0.1, 0.6]))
            if len(docs):
                lists.append((docs, rng.integers(0, rng.choice([4, 1000]), len(docs))))
        total = np.zeros(n, np.int64)
        for docs, scores in lists:
            total[docs] += scores
        ids, unnamed = rng.permutation(n), rng.random(n) < 0.1
        order = np.lexsort((ids, unnamed, -total))[:5]
        expected = [(total[d], unnamed[d] or ids[d]) for d in order if total[d] > 0]
        best = lexical.Best(5)
        lexical.search_block(lists, n, ids, unnamed, best, window=int(rng.choice([3, 50, 2048])), short=int(rng.choice([0, 20, 1000])))
        assert [(s, u or i) for s, i, u in zip(best.scores, best.ids, best.unnamed)][: len(expected)] == expected and len(best.scores) == len(expected), trial


def test_odd_rows(spark, odd_rows, empty):
    items = [(1, "The same words, CAT and été"), (1, "mat œuvre"), (None, "漢字 aaaaaaaa words"), (2, None), (3, ""), (4, "absent"), (5, "x12 12"), (6, "the the the")]
    table = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "'q' as term", "1 as rank", "2 as score")
    docs = [(r.doc_id, r.text) for r in odd_rows.collect()]
    assert got(lexical.rank_documents(odd_rows, table)) == exact(docs, items)
    assert got(lexical.rank_documents(odd_rows, table, k=2)) == exact(docs, items, 2)
    assert lexical.rank_documents(empty, table).count() == 0
    assert lexical.rank_documents(odd_rows, table.filter("false")).count() == 0
