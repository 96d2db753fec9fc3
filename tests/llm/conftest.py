import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, start=0):
    """texts as a table, two of whose columns have names that operators use themselves."""
    data = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts, start)]
    return spark.createDataFrame(data, DOCUMENTS)


#: Texts that every operator must take: null, empty, blank, repeated, very long.
ODD = [None, "", " \n\t ", "word", "word", "é" * 300, "x " * 3000, "y" * 20_000, "\x1c\u00a0\u200b", "a\x00b", "😀 smile", "the same text again and again and again and on"]


@pytest.fixture(scope="session")
def vocabulary_file():
    return pytest.importorskip("public_tokenizers").path
