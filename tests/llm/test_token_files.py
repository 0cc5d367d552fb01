import glob
import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from lumenstack.llm import token_files
from lumenstack.llm.components import scratch_path

DEFINITION = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()


def exact(rows):
    tokenizer = Tokenizer.from_str(DEFINITION)
    tokenizer.encode_special_tokens = True
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=str)


@pytest.mark.parametrize("file_bytes", [50_000, 48_000_000])
def test_round_trip(spark, documents, monkeypatch, file_bytes):
    monkeypatch.setattr(token_files, "FILE_BYTES", file_bytes)
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(documents, DEFINITION, path)
    rows = token_files.token_index(token_files.read_tokens(spark, path)).collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows), key=str) == exact([(r.doc_id, r.text) for r in documents.collect()])


def test_format(spark, documents):
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(documents, DEFINITION, path, row_group_bytes=64 << 10, page_bytes=8 << 10, page_rows=50)
    files = glob.glob(path.removeprefix("file:").replace("///", "/") + "/*.parquet")
    metas = [pq.ParquetFile(f).metadata for f in files]
    assert sum(m.num_row_groups for m in metas) > len(metas)
    columns = [m.row_group(0).column(c) for m in metas for c in range(m.num_columns)]
    assert any("DELTA_BINARY_PACKED" in c.encodings for c in columns if "ids" in c.path_in_schema)
    assert all(c.has_offset_index and c.has_column_index for c in columns if "ids" not in c.path_in_schema)
    plan = token_files.read_tokens(spark, path).filter("doc_id = 7").select("n_tokens")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in plan and "ids" not in plan.split("ReadSchema")[1]


def test_odd_rows(spark, odd_rows, empty):
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(odd_rows, DEFINITION, path)
    rows = token_files.token_index(token_files.read_tokens(spark, path)).collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows), key=str) == exact([(r.doc_id, r.text) for r in odd_rows.collect()])
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(empty, DEFINITION, path)
    assert token_files.token_index(token_files.read_tokens(spark, path)).count() == 0


def test_stretches_keep_ids():
    import random

    rng, encoder = random.Random(7), token_files.Encoder(DEFINITION, public_tokenizers.PATTERN)
    assert encoder.by_piece
    for _ in range(400):
        text = "".join(rng.choice(["ab", "'s", " ", "  ", "\n", ".", "12", "!", "\x1c", "\x85", "　", "éa", "漢", ",", "<|endoftext|>"]) for _ in range(25))
        assert encoder.texts([text])[0] == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_special_tokens_as_the_library_has_them(spark):
    untouched = Tokenizer.from_str(DEFINITION)
    texts = ["a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> x", "word.<|endoftext|>\n\n<|endoftext|>!", "<|endoftext", "ab|<|endoftext|>"]
    assert untouched.encode(texts[0], add_special_tokens=False).ids == [64, 50256, 65]
    encoder = token_files.Encoder(DEFINITION, public_tokenizers.PATTERN)
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.texts(texts)] == [untouched.encode(t, add_special_tokens=False).ids for t in texts]
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), DEFINITION, path)
    rows = token_files.read_tokens(spark, path).collect()
    assert {r.doc_id: r.ids for r in rows} == {k: [*untouched.encode(t, add_special_tokens=False).ids, 0] for k, t in enumerate(texts)}


def test_special_tokens_that_take_white_space():
    parts = json.loads(DEFINITION)
    parts["added_tokens"][0]["lstrip"] = True
    untouched, encoder = Tokenizer.from_str(json.dumps(parts)), token_files.Encoder(json.dumps(parts), public_tokenizers.PATTERN)
    text = "a  <|endoftext|> b"
    assert np.frombuffer(encoder.texts([text])[0], "<u4").tolist() == untouched.encode(text, add_special_tokens=False).ids
