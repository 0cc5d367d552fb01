from pyspark.sql import functions as F

from lumenstack.llm import toxicity


def test_held_out_rows(spark, documents, sf_dir):
    path = sf_dir.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.fit(docs.filter(~held), labels.filter(~held))
    rows = toxicity.score(docs.filter(held), model).join(labels, "doc_id").select("toxic", "predicted", "score").collect()
    assert sum(r.toxic == r.predicted for r in rows) >= 0.9 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_short_words_decide():
    model = toxicity.train([b"you are a fool", b"what a fool he is", b"a fine day"] * 10 + [b"a fine road", b"the sea is calm"] * 15, [1, 1, 0] * 10 + [0, 0] * 15, stand_out=1.0)
    import numpy as np

    texts = [b"such a FOOL", b"such a calm day", b""]
    score = model.scores(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert score[0] > 0.5 > score[1] and score[2] < 0.5


def test_odd_rows(spark, odd_rows, empty):
    labels = spark.createDataFrame([(7, 0), (5, 1), (2, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(odd_rows, labels)
    assert toxicity.score(odd_rows, model).count() == odd_rows.count()
    assert toxicity.fit(empty, labels) is None
    assert {r.predicted for r in toxicity.score(odd_rows, None).collect()} == {0}
    assert toxicity.score(empty, model).count() == 0
