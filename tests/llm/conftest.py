import pytest


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and very long texts, ties and repeated rows, and a column whose name clashes."""
    long = "word and another " * 20_000
    rows = [(1, None, "a"), (2, "", "b"), (3, "", "b"), (None, "null id", None), (5, "same text here", "x"),
            (5, "same text here", "x"), (6, long, "y"), (7, "é 日本 <|endoftext|> x\u0085y", "z"), (8, " \n\t ", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
