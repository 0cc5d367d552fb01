import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lumenstack.llm import alignment
from lumenstack.llm.queries import op13_token_alignment

DEFINITION = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()


@pytest.fixture(scope="module")
def tokens():
    return alignment.Tokens(DEFINITION, public_tokenizers.PATTERN, MODEL)


@pytest.fixture(scope="module")
def library():
    """(a ids, b ids) of a text by the two libraries, nothing remembered; without those whose bytes differ."""
    a, b = Tokenizer.from_str(DEFINITION), sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    a.encode_special_tokens = True
    letters = alignment.level_bytes()

    def encode(text):
        if not text:
            return [], []
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        of_x = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
        of_y = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        raw = (" " + text).encode()
        return ([*zip(x, of_x)], [*zip(y, of_y)]) if b"".join(of_x) == raw == b"".join(of_y) else ([], [])

    return encode


def brute(texts, library, relation="end"):
    """Per text n_a, n_b, n_groups, n_links, n_best, count_sum, sha256, by loops over tokens."""
    links, rows, counts = [], [], Counter()
    for text in texts:
        a, b = library(text)
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, raw in side:
                out.append((at, at + len(raw), i))
                at += len(raw)
            spans.append(out)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = [([], []) for _ in cuts]
        for k, side in enumerate(spans):
            at = 0
            for _, e, i in side:
                groups[at][k].append(str(i))
                at += e == cuts[at]
        groups = ["|".join(map(",".join, g)) for g in groups]
        ending = {f: (t, j) for t, f, j in spans[1]}
        own = [(i, ending[e][1]) for s, e, i in spans[0] if e in ending and (relation == "end" or s == ending[e][0])]
        counts.update(own)
        links.append(own)
        rows.append([len(a), len(b), len(groups), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""])
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(most.get(j, 0), n)
    return [(*r[:4], sum(counts[p] == most[p[1]] for p in own), sum(counts[p] for p in own), r[4]) for r, own in zip(rows, links)]


def digests(rows):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows]


def test_query_by_brute_force(spark, sf_dir, documents, library):
    rows = sorted(op13_token_alignment(spark, sf_dir).collect(), key=lambda r: r.doc_id)
    docs = sorted(documents.collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == [r.doc_id for r in docs]
    assert digests(rows) == brute([r.text for r in docs], library)


@pytest.mark.parametrize("relation", ["end", "equal"])
def test_odd_rows(spark, odd_rows, empty, library, relation):
    rows = alignment.align_and_score(odd_rows, DEFINITION, MODEL, relation).collect()
    docs = odd_rows.collect()
    expected = zip((r.doc_id for r in docs), brute([r.text for r in docs], library, relation))
    assert sorted(zip((r.doc_id for r in rows), digests(rows)), key=str) == sorted(expected, key=str)
    assert alignment.align_and_score(empty, DEFINITION, MODEL, relation).count() == 0


def test_stretches_keep_ids(tokens, library):
    assert tokens.by_stretch
    rng = random.Random(11)
    parts = ["ab", "The", "'s", " ", "  ", "   ", "\n", "\n\n", "\t", ".", ",", "12", "!", "\x1c", "\x85", "　", "éa", "漢", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "ﬁ", "é́", "😀", "\x00", "ing", "\r", "\r\n", ");", "}", "▁", "word."]
    texts = ["".join(rng.choice(parts[: len(parts) - rng.choice([0, 2])]) for _ in range(rng.randint(1, 25))) for _ in range(6000)]
    for text in texts:
        a, b = library(text)
        own = [np.frombuffer(x, "<u4").tolist() for x in tokens.text(text)]
        assert own == [[i for i, _ in a], [i for i, _ in b]], repr(text)
    assert tokens.odd


def test_pieces_of_the_vocabulary_as_texts(tokens, library):
    for k in range(0, tokens.b.get_piece_size(), 7):
        text = "x " + tokens.b.id_to_piece(k) + " y"
        assert [np.frombuffer(x, "<u4").tolist() for x in tokens.text(text)] == [[i for i, _ in side] for side in library(text)], text


def test_forgotten_stretches_that_differ(tokens, library, monkeypatch):
    monkeypatch.setattr(alignment, "MOST_HELD", 3)
    for text in ["a▁b one two three four", "five six seven", "eight nine ten eleven", "a▁b", "a▁b one", "one"] * 2:
        assert [np.frombuffer(x, "<u4").tolist() for x in tokens.text(text)] == [[i for i, _ in side] for side in library(text)], text


def test_whole_texts(tokens, library, monkeypatch):
    monkeypatch.setattr(tokens, "by_stretch", False)
    for text in ["two  words, and more.", "a▁b", "", " x ", "漢\nz"]:
        assert [np.frombuffer(x, "<u4").tolist() for x in tokens.text(text)] == [[i for i, _ in side] for side in library(text)], text


def test_pairs_hold_all_links(documents, tokens):
    known = tokens.pairs("end")
    assert len(known) <= sum(map(len, tokens.bytes_a)) + sum(map(len, tokens.bytes_b)) + 1000
    rows = alignment.align(documents, DEFINITION, MODEL, keep=("a_ids", "b_ids", "a_groups", "b_groups", "link_a", "link_b", "pairs")).collect()
    for r in rows:
        size = len(tokens.bytes_b)
        assert [divmod(int(known[p]), size) for p in r.pairs] == [(r.a_ids[i], r.b_ids[j]) for i, j in zip(r.link_a, r.link_b)]
        ends = [np.cumsum([len(x[i]) for i in ids]) for x, ids in ((tokens.bytes_a, r.a_ids), (tokens.bytes_b, r.b_ids))]
        assert all(ends[0][i] == ends[1][j] for i, j in zip(r.link_a, r.link_b))
        for groups, e in ((r.a_groups, ends[0]), (r.b_groups, ends[1])):
            common = np.intersect1d(*ends)
            assert groups == np.searchsorted(common, e).tolist()


def test_relation_equal(documents, tokens):
    rows = alignment.align(documents.limit(20), DEFINITION, MODEL, "equal").collect()
    for r in rows:
        assert all(tokens.bytes_a[r.a_ids[i]] == tokens.bytes_b[r.b_ids[j]] for i, j in zip(r.link_a, r.link_b)) and (r.link_a or not r.a_ids)
