import pytest

LONG = "the quick brown fox and the lazy dog. " * 3000


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns named like the operators' own."""
    rows = [
        (1, "Hello there, how are you today my friend?", "en"),
        (1, "Hello there, how are you today my friend?", "en"),
        (2, "Hello there, how are you today my friend?", None),
        (3, None, "en"),
        (4, "", "fr"),
        (5, " \n\t ", None),
        (6, LONG, "en"),
        (7, LONG, "en"),
        (None, "an id is missing here but the text is fine", "en"),
        (None, None, None),
        (8, "12345 67890 !!! ???", "de"),
        (9, "Ünïcödé 日本語 \U0001f600 <|endoftext|> <|startoftext|> </s>", "de"),
        (10, "one", "en"),
        (11, "a\u0000b \u2028 c\u00a0d  e   f\r\ng", "en"),
    ]
    clash = "doc_id long, text string, lang string, keep_id string, content string, digest string, class_id string, lang_pred int, row string, ids string, n_tokens string"
    return spark.createDataFrame([(*r, "x", "y", "z", "c", 1, "r", "i", "n") for r in rows], clash)


@pytest.fixture(scope="session")
def no_rows(awkward):
    return awkward.limit(0)
