import numpy as np
from pyspark.sql import functions as F

from lumenstack.llm import langid


def test_held_out_accuracy(documents):
    docs = documents.withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    model = langid.fit(docs.filter(~F.col("held_out")), epochs=12)
    rows = langid.predict(docs.filter("held_out"), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_windows_cover_whole_texts():
    flat = np.frombuffer(b"abcdefghij" + b"xyz", np.uint8)
    _, start, length, doc = langid.cut_windows(flat, np.array([0, 10, 10, 13]), 4, 3)
    assert start.tolist() == [0, 4, 8, 10] and length.tolist() == [4, 4, 2, 3] and doc.tolist() == [0, 0, 0, 2]


def test_odd_rows(odd_rows, empty, documents):
    model = langid.fit(documents, per_lang=160, epochs=2)
    found = {(r.doc_id, r.lang_pred, r.score) for r in langid.predict(odd_rows, model).collect() if r.doc_id in (1, 2, 3, 4)}
    assert found == {(i, "und", 0.0) for i in (1, 2, 3, 4)}
    assert langid.predict(odd_rows, model).columns.count("score") == 1
    assert langid.fit(empty) is None
    assert {r.lang_pred for r in langid.predict(odd_rows, None).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0
