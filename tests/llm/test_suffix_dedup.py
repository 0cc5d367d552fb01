import hashlib
import random

import numpy as np
import pytest

from lumenstack.llm import suffix_dedup as sd


def brute(rows, length):
    """(removed, spans, kept) by row number."""
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            if i is not None and (w not in first or first[w] > i):
                first[w] = i
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if i is not None and first[t[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def test_passages_edits_and_overlaps(spark):
    rng = random.Random(2)
    words = ["the", "of", "ab", "abab", "été", "x", "sea", "漢"]
    base = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(6)]
    rows = []
    for k in range(60):
        parts = [b[a : a + rng.randint(20, 400)] for b in rng.sample(base, 2) for a in (rng.randrange(500),)]
        text = rng.choice(["", "start "]) + rng.choice(["", " ; ", "-" * 70]).join(parts) + str(k)
        if rng.random() < 0.3:
            p = rng.randrange(len(text))
            text = text[:p] + "#" + text[p + 1 :]
        rows.append((rng.choice([k, k, k // 2]), text))
    rows += [(100, "z" * 500), (101, "z" * 49), (102, "y" * 60 + "z" * 120), (103, base[0]), (50, base[0]), (99, base[0])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(sd.drop_repeats(df)) == brute(rows, 50)


@pytest.mark.parametrize("common", [2, 10_000])
def test_common_minimizers(spark, monkeypatch, common):
    monkeypatch.setattr(sd, "COMMON", common)
    monkeypatch.setattr(sd, "SLICE", 300)
    rng = random.Random(4)
    notice = "all rights to this passage are kept by those who wrote it down"
    rows = [(i, f"{rng.getrandbits(200):x} {notice if i % 3 else notice[:40]} {rng.getrandbits(200):x}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert found(sd.drop_repeats(df)) == brute(rows, 50)


def test_orders():
    rng = random.Random(6)
    text = bytes(rng.choice(b"ab") for _ in range(400)) + b"ab" * 40
    at = np.arange(len(text) - 50)
    order, segment = sd.shallow_sort(sd.words_at_each_byte(np.frombuffer(text, np.uint8)), at, np.zeros(len(at), np.int64))
    assert [text[p : p + 16] for p in order] == sorted(text[p : p + 16] for p in at)
    assert all((segment[i] == segment[i + 1]) == (text[order[i] : order[i] + 16] == text[order[i + 1] : order[i + 1] + 16]) for i in range(len(order) - 1))
    groups = [[text[at[i] : at[i] + 50] for i in items] for items in sd.deep_sort(text, at, 50)]
    assert [g[0] for g in groups] == sorted({text[p : p + 50] for p in at}) and all(len(set(g)) == 1 for g in groups)


def test_odd_rows(odd_rows, empty):
    rows = [(r.doc_id, r.text) for r in odd_rows.select("doc_id", "text").collect() if len(r.text or "") < 20_000]
    small = odd_rows.filter("text is null or length(text) < 20000")
    assert found(sd.drop_repeats(small)) == brute(rows, 50)
    whole = {r.doc_id: r for r in sd.drop_repeats(odd_rows, texts=True).collect()}
    assert whole[5].n_removed == whole[6].n_removed == 0
    assert whole[8].kept_text == "" and whole[8].n_removed == whole[8].n_bytes
    assert sd.drop_repeats(empty).count() == 0
