import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lumenstack.llm import packing
from lumenstack.llm.queries import op11_pack_sequences

DEFINITION = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()


def exact_pieces(docs, capacity):
    """(doc_id, piece, start, length, crc) of each piece, from the library."""
    tokenizer, out = Tokenizer.from_str(DEFINITION), []
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        starts = [0, *range(first, len(ids), capacity)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            out.append((doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return sorted(out, key=str)


def check(rows, docs, capacity, groups=1):
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == exact_pieces(docs, capacity)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        ends = [0]
        for offset, length in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= capacity
    least = -(-sum(r.length for r in rows) // capacity)
    assert least <= len(held) <= least * 1.01 + 2 * groups


def test_query(spark, sf_dir, documents):
    check(op11_pack_sequences(spark, sf_dir).collect(), [(r.doc_id, r.text) for r in documents.collect()], 2048)


def test_small_groups(documents, monkeypatch):
    monkeypatch.setattr(packing, "BATCH_BYTES", 20_000)
    cut = packing.pieces(documents, DEFINITION, 256).cache()
    rows = packing.pack(cut, 256, group_pieces=500).collect()
    check(rows, [(r.doc_id, r.text) for r in documents.collect()], 256, groups=cut.count() // 500 + 1)


def test_sum_of_squares_by_brute_force():
    """Each piece against the sum of squares of all places it could take."""
    rng = np.random.default_rng(3)
    for sizes in (rng.integers(1, 41, 300), rng.choice([6, 7, 20], 400), np.array([40, 40, 1, 39]), np.zeros(0, int)):
        sizes = np.sort(sizes)[::-1]
        sequence, offset = packing.sum_of_squares(sizes, 40)
        used = []
        for s, which, at in zip(sizes.tolist(), sequence.tolist(), offset.tolist()):
            def squares(gaps):
                return sum(n * n for n in np.bincount(gaps, minlength=41)[1:].tolist())

            gaps = [40 - u for u in used]
            ways = [(squares([*gaps[:k], g - s, *gaps[k + 1 :]]), g - s) for k, g in enumerate(gaps) if g >= s]
            if ways:
                assert at == used[which] and (squares([*gaps[:which], gaps[which] - s, *gaps[which + 1 :]]), gaps[which] - s) == min(ways)
                used[which] += s
            else:
                assert (which, at) == (len(used), 0)
                used.append(s)


def test_odd_rows(odd_rows, empty):
    docs = [(r.doc_id, r.text) for r in odd_rows.collect()]
    check(packing.pack_documents(odd_rows, DEFINITION, 2048).collect(), docs, 2048)
    check(packing.pack_documents(odd_rows, DEFINITION, 1).collect(), docs, 1)
    assert packing.pack_documents(empty, DEFINITION).count() == 0


def test_copies_of_one_row_are_dealt_out(spark):
    same = spark.range(4000).selectExpr("cast(null as bigint) as doc_id", "'one and the same text' as text").repartition(3)
    cut = packing.pieces(same, DEFINITION).cache()
    rows = packing.pack(cut, 2048, group_pieces=500).collect()
    groups = defaultdict(int)
    for r in rows:
        groups[r.sequence_id >> 32] += 1
    assert len(rows) == 4000 and len(groups) == 9 and max(groups.values()) < 700


def test_sequences_hold_the_ids(documents):
    packed = packing.pack_documents(documents, DEFINITION, 512, with_ids=True).cache()
    tokenizer = Tokenizer.from_str(DEFINITION)
    ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0] for r in documents.collect()}
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        held = whole[r.sequence_id]
        assert held.ids[r.offset : r.offset + r.length] == ids[r.doc_id][r.start : r.start + r.length] == r.ids
        assert len(held.ids) <= 512 and (r.doc_id, r.offset) in zip(held.doc_ids, held.offsets)
