import pytest


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(documents):
    """doc_id to text, null as empty."""
    return {r["doc_id"]: r["text"] or "" for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"word{i % 977} tail{i % 13}" for i in range(60_000))
    rows = [
        (1, None, None, None, None, "x", 1),
        (2, "", "en", "s", 0, "x", 1),
        (3, "same words here again and again for everyone", "en", "s", 44, "x", 1),
        (4, "same words here again and again for everyone", "de", None, 44, "x", 1),
        (4, "same words here again and again for everyone", "de", None, 44, "x", 1),
        (None, "no id but a text: mail bob@example.org or +49 30 1234567", None, "s", 10, "y", 2),
        (None, None, None, None, None, None, None),
        (5, long, "en", "s", len(long), "x", 1),
        (6, long + " more", "en", "s", len(long) + 5, "x", 1),
        (7, "   \n\t ", "en", "s", 6, "x", 1),
        (8, "emoji 😀 and ünïcode text \x00 nul", "fr", "s", 3, "x", 1),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id string, fp int"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
