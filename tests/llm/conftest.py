import pytest

#: Ids and texts that every operator must take: nulls, blanks, repeated rows, ties, odd characters, one long text.
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "a"),
    (5, "same text here"),
    (5, "same text here"),
    (6, "same text here"),
    (None, "no id at all"),
    (7, "日本語 🙂 \u0000 ÀÉ ñ"),
    (8, "word " * 20_000),
    (9, "x" * 70_000),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with the odd texts and further columns, some named like the operators' own."""
    rows = [(i, t, "en", "s", len(t or ""), "x", 1, "y", 2, 3) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, node int, lost_key string, rainloom_lang int, Searched int")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
