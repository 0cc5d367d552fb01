import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from lumenstack.llm import bpe

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
EXACT = tiktoken.Encoding("exact", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(RANKS, public_tokenizers.PATTERN)


def check(rows, texts):
    for r in rows:
        text = texts[r.doc_id] or ""
        ids = EXACT.encode_ordinary(text)
        assert r.ids == ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_same_ids_as_the_exact_encoder(documents, vocabulary):
    rows = bpe.encode_decode(documents, vocabulary, with_ids=True).collect()
    check(rows, {r.doc_id: r.text for r in documents.collect()})
    assert len(rows) == documents.count()


def test_odd_rows(odd_rows, empty, vocabulary):
    rows = bpe.encode_decode(odd_rows, vocabulary, with_ids=True).collect()
    check(rows, {r.doc_id: r.text for r in odd_rows.collect()})
    assert len(rows) == odd_rows.count()
    assert bpe.encode_decode(empty, vocabulary).count() == 0


@pytest.mark.parametrize("bound", ["MOST_HELD", "MOST_WORDS"])
def test_dictionaries_are_emptied(documents, vocabulary, monkeypatch, bound):
    monkeypatch.setattr(bpe, bound, 300)
    common = bpe.CommonWords(pa.table({"word": pa.array([b" the"])}))
    shared, known = (type("Shared", (), {"value": v}) for v in (vocabulary, common))
    table = documents.select("doc_id", "text").toArrow().to_batches()[0]
    rows = [r for b in bpe._with_words((table.slice(k, 40) for k in range(0, len(table), 40)), shared, known) for r in b.to_pylist()]
    assert [r["kind"] for r in rows].count(bpe.DOCUMENT) == len(table)
    assert (len({r["generation"] for r in rows}) > 1) == (bound == "MOST_WORDS")
    words, texts = {}, dict(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist()))
    for r in rows:
        if r["kind"] == bpe.WORD:
            words[r["generation"], r["number"]] = r["word"]
        else:
            numbers = [int.from_bytes(r["refs"][k : k + 4], "little") for k in range(0, len(r["refs"]), 4)]
            assert b"".join(b" the" if k == 0 else words[r["generation"], k] for k in numbers) == (texts[r["number"]] or "").encode()


def test_lost_words_are_seen(spark, vocabulary):
    ids = spark.createDataFrame([(b"a", [1], b"a")], "word binary, ids array<int>, decoded binary").toArrow()
    words = bpe._Words(ids)
    with pytest.raises(ValueError):
        words.add(np.array([2]), pa.array([[5]], pa.list_(pa.int32())), pa.array([b"x"]))
    with pytest.raises(ValueError):
        bpe._put_together(pa.array([1]), np.array([0, 1], np.int32).view(np.uint8), np.array([0, 8]), words, True)


def test_generations_give_the_same_ids(documents, odd_rows, vocabulary, monkeypatch):
    """Words folded in a task of their own, for all tasks or one by one: few common words, small generations and parts."""
    monkeypatch.setattr(bpe, "COMMON_BYTES", 2000)
    rows = bpe.encode_decode(odd_rows.unionByName(documents, allowMissingColumns=True), vocabulary, with_ids=True)
    texts = {r.doc_id: r.text for r in documents.collect()} | {r.doc_id: r.text for r in odd_rows.collect()}
    check([r for r in rows.collect() if r.doc_id is None or r.doc_id > 10], texts)


def test_fold_and_heap_on_any_word(spark, vocabulary):
    rng = random.Random(3)
    words = ["".join(rng.choice(["a", "th", "ing", "é", "漢", "zq", "́"]) for _ in range(rng.randint(1, 14))) for _ in range(150)] + ["ab" * 120]
    rows = spark.createDataFrame([(w, c) for w, c in zip(words, vocabulary.cells([w.encode() for w in words]).to_pylist())], "w string, cells array<bigint>")
    ids = bpe.encoded(F.col("w").cast("binary"), F.col("cells"), vocabulary)
    for r in rows.withColumn("ids", ids).withColumn("back", bpe.decoded(F.col("ids"), vocabulary)).collect():
        whole = [RANKS[r.w.encode()]] if r.w.encode() in RANKS else EXACT._core_bpe.encode_single_piece(r.w.encode())
        assert r.ids == whole
        assert bytes(r.back) == r.w.encode()
        assert bpe.merged_by_heap(r.w.encode(), RANKS) == whole


def test_tokens_that_do_not_fold_to_themselves(spark):
    """A token whose merges are not in the vocabulary is one id as a word, and its merges inside longer words."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"xyz": 257}
    vocabulary = bpe.Vocabulary(ranks, public_tokenizers.PATTERN)
    exact = tiktoken.Encoding("few", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["xyz", "xyz xyzab", "abxyz ab"]
    rows = bpe.encode_decode(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), vocabulary, with_ids=True).collect()
    assert {r.doc_id: r.ids for r in rows} == {k: exact.encode_ordinary(t) for k, t in enumerate(texts)}


def test_stretches_keep_pieces_whole():
    rng = random.Random(5)
    for _ in range(500):
        text = "".join(rng.choice(["a", "'s", " ", "  ", "\n", "\t", "1", "!", "\x1c", "\x85", "　", "é", "'"]) for _ in range(20))
        pieces = [p for s in bpe.STRETCH.findall(text) for p in regex.findall(public_tokenizers.PATTERN, s)]
        assert pieces == regex.findall(public_tokenizers.PATTERN, text), repr(text)


def test_bounds_change_no_row(documents, vocabulary):
    found = [bpe.encode_decode(documents, vocabulary, with_ids=True, **bounds).collect() for bounds in ({}, {"common_bytes": 5_000, "most_words": 200, "most_held": 100})]
    assert sorted(found[0]) == sorted(found[1])


def test_bounds_hold_inside_a_batch_of_long_texts(vocabulary):
    """40 texts of 50 kB, all of new words, in one batch: the words of a generation stay near the bound."""
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(5_000)) for _ in range(40)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": texts})
    shared, known = (type("Shared", (), {"value": v}) for v in (vocabulary, bpe.CommonWords(pa.table({"word": pa.array([b" the"])}))))
    rows = [r for b in bpe._with_words(iter([batch]), shared, known, 1_000) for r in b.select(["kind", "generation"]).to_pylist()]
    assert {r["generation"] for r in rows} == {0, 1}


def test_no_dictionary_of_common_words_is_left_in_a_worker(vocabulary):
    common = bpe.CommonWords(pa.table({"word": pa.array([b" the"])}))
    shared, known = (type("Shared", (), {"value": v}) for v in (vocabulary, common))
    list(bpe._with_words(iter([pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["see the sea"]})]), shared, known))
    assert set(vars(common)) == {"table"}


def test_documents_put_together_apart(documents, odd_rows, empty, vocabulary, monkeypatch):
    """Many tasks, each of several generations, through the shuffle: the same rows."""
    monkeypatch.setattr(bpe, "TASK_BYTES", 60_000)
    docs = odd_rows.unionByName(documents.repartition(7), allowMissingColumns=True)
    found = [bpe.encode_decode(docs, vocabulary, with_ids=True, common_bytes=2_000, most_words=200, apart=apart).collect() for apart in (False, True)]
    assert sorted(found[1], key=repr) == sorted(found[0], key=repr)
    texts = {r.doc_id: r.text for r in documents.collect()} | {r.doc_id: r.text for r in odd_rows.collect()}
    check([r for r in found[1] if r.doc_id is None or r.doc_id > 10], texts)
    assert bpe.encode_decode(empty, vocabulary, apart=True).count() == 0


@pytest.mark.parametrize("apart", [False, True])
def test_neither_plans_nor_rows_hold_the_vocabulary(documents, vocabulary, apart):
    """The text of a plan, kept in the driver for each run and change of it, stays small; no column carries a constant."""
    rows = bpe.encode_decode(documents, vocabulary, with_ids=True, apart=apart)
    plan = rows._jdf.queryExecution().toString()
    assert len(plan) < 200_000
    chosen = rows._jdf.queryExecution().executedPlan().toString()
    assert "ubquery" in chosen and "__rank_map" not in chosen and "__pieces" not in chosen
