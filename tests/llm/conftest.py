import pytest


@pytest.fixture(scope="session")
def vocab():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def odd(spark):
    """documents with nulls, empty, wordless and very long texts, repeated rows, ties, and columns of clashing names."""
    long = "the quick brown fox and lazy dog " * 5000
    rows = [
        (1, "Hello world, this is the end of the day.", "en", "a", 40), (2, "Hello world, this is the end of the day.", "en", "b", 40), (3, "", "en", "a", 0), (4, None, None, None, None), (5, " \n\t ", None, "b", 4),
        (6, long, "en", "a", len(long)), (7, "12 34 !!", "de", None, 8), (8, "ein Haus und der Garten", "de", "b", 23), (8, "ein Haus und der Garten", "de", "b", 23), (None, "no id at all", "en", "a", 12), (9, "中文 字", None, "", 4), (10, "x", "en", "b", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "1 AS n_tokens", "2 AS lang_pred", "3 AS score", "4 AS component_id", "5 AS taken", "6 AS kept", "7 AS n_words")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
