import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text int, kept string, fp long, row int, _place int, _gone int, _doc int, _id string"


def awkward_rows():
    words = " ".join(f"w{i}é" for i in range(30_000))
    return [
        (1, None, None, None, None, 1, "x", 1, 1),
        (2, "", "en", "s", 0, None, None, None, None),
        (3, " \t\n ", None, "s", 4, None, None, None, None),
        (4, "One two  three\n four", "en", None, 20, None, None, None, None),
        (5, "ONE two  three\n four", "en", None, 20, None, None, None, None),
        (6, "a" * 70_000, "en", "s", None, None, None, None, None),
        (7, words, "en", "s", None, None, None, None, None),
        (8, words + " tail", "en", "s", None, None, None, None, None),
        (9, "Straße ÉCOLE 东京 \U0001f600 it's we'll 12 345", "de", "s", None, None, None, None, None),
        (10, "One two  three\n four", "en", None, 20, None, None, None, None),
        (10, "One two  three\n four", "en", None, 20, None, None, None, None),
        (10, "another text under the same id", "en", None, 20, None, None, None, None),
        (None, "a text without an id <|endoftext|> and more", "en", None, 20, None, None, None, None),
        (None, "a text without an id <|endoftext|> and more", "en", None, 20, None, None, None, None),
        (None, "One two  three\n four", None, None, None, None, None, None, None),
        (12, "hello <|endoftext|> bye <|endoftext|>", None, None, None, None, None, None, None),
        (11, " lead and trail  ", "en", None, 20, None, None, None, None),
    ]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated rows and clashing extra columns."""
    return spark.createDataFrame([r + (1, 1, 1, "i") for r in awkward_rows()], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
