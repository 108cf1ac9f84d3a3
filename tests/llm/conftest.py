import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"


@pytest.fixture(scope="session")
def make(spark):
    """documents of (doc_id, text[, lang, source]) with a column whose name some outputs have too."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", len(r[1] or ""), 0.5) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return build


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
