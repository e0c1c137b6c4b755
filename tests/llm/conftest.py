import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, id string, `__finds` int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names the operators use themselves."""

    def make(texts, lang="en", source="src1"):
        rows = [(i, t, lang, source, len(t or ""), 0.5, "x", 1) for i, t in (enumerate(texts) if not texts or not isinstance(texts[0], tuple) else texts)]
        return spark.createDataFrame(rows, DOCS)

    return make


ODD = [None, "", " \n\t", "word", "word", "é à ü ñ", "x" * 5000, "tail " * 3000, "<|endoftext|> [INST] </s> \\", "日本語 テキスト"]


@pytest.fixture(scope="session")
def odd():
    return ODD
