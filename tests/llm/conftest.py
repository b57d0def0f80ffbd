import pytest

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, and columns that operators use inside."""
    long_text = " ".join(f"word{i % 977} and {i}" for i in range(60_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 69),
        (2, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 69),
        (2, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 69),
        (3, None, "en", "a", None),
        (4, "", "de", None, 0),
        (5, " \t\n ", None, "b", 4),
        (6, long_text, "en", "b", len(long_text)),
        (None, "no id here but some words all the same", "fr", "c", 40),
        (None, None, None, None, None),
        (7, "Ünïcödé ß 日本語 \U0001f600 ÉCOLE", "fr", "c", 30),
        (8, "x", "en", "a", 1),
        (-9, "negative ids are ids too", "en", "a", 24),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    extra = {c: "clash" for c in ("key", "part", "d", "held", "kept_id", "leak_id", "sd", "label_", "id", "of", "root", "node", "text_key", "score")}
    from pyspark.sql import functions as F

    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((x is not None, x) for x in r))


__all__ = ["FOLDER", "rows"]
