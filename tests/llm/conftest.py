import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, _mix_size string, h string"
#: null in every column, empty and long texts, repeated rows, ties, a repeated id with another text
ODD = [
    (1, "one two three four five six seven", "en", "a", 3, "x", "y"),
    (1, "one two three four five six seven", "en", "a", 3, "x", "y"),
    (1, "another text with the same id", "en", "b", 3, None, None),
    (2, None, None, None, None, None, None),
    (3, "", "en", "b", 0, None, None),
    (None, "no id here but words", None, "c", None, None, None),
    (None, None, None, None, None, None, None),
    (None, None, None, None, None, None, None),
    (4, "long " * 40000, "en", "a", None, None, None),
    (5, "x" * 100000, "en", "a", None, None, None),
    (6, " \t\n\x0b\x0c\r ", "fr", "c", None, None, None),
    (7, "été über ñandú nbsp ́ 𝒳 <|endoftext|> it's", "fr", "c", None, None, None),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOC).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
