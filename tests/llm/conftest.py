import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd_rows(spark):
    """Nulls in every column, empty, blank, letterless and very long texts, repeated rows and ids, a clashing column."""
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", "en", None, 4),
        (4, "12 34 !!", None, "a", 8),
        (5, "the cat sat on the mat and looked at the long grey road to the sea " * 900, "en", "a", 60300),
        (6, "aaaaaaaa" * 4000, "en", "b", 32000),
        (7, "the same words stand here twice, once in each of these two rows of text", "en", "b", 70),
        (7, "the same words stand here twice, once in each of these two rows of text", "en", "b", 70),
        (8, "the same words stand here twice, once in each of these two rows of text", "en", "b", 70),
        (None, "the same words stand here twice, once in each of these two rows of text", "en", "b", 70),
        (9, "été à l'œuvre, ça va? 漢字 \x1c\x85  　 x", "fr", "c", 30),
        (10, "Released under the MIT License.", "en", "c", 31),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "'x' as score", "'y' as lang_pred", "1 as slot", "2 as fp", "3 as kind", "4 as h")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
