import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size string, rank int, score int, part int"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in any column, empty, blank, tiny and long texts, ties, repeated rows, clashing extra columns."""
    long_text = " ".join(f"word{i % 700}x{i // 700}" for i in range(30_000))
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen " \
           "seventeen eighteen nineteen twenty twentyone twentytwo"
    near = base + " twentythree"
    texts = [(1, base, "en", "a"), (2, near, "en", "a"), (3, base, None, None), (4, None, "en", "b"), (5, "", "fr", "b"),
             (6, " \n\t ", None, None), (7, long_text, "en", "c"), (8, "x", "xx", "c"), (9, "ONE Two", "de", "a"),
             (10, "no\u00ebl \U0001d4d0\u4e2d\u6587 ### 123", "fr", "a"), (None, base, "en", "a"), (None, None, None, None),
             (11, base.upper(), "es", None), (1, base, "en", "a"), (1, base, "en", "a")]
    rows = [(i, t, lang, src, None if t is None else len(t), "k", "s", 1, 2, 3) for i, t, lang, src in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
