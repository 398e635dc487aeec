import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with the operators' own."""
    def make(rows):
        wide = [(i, t, "en" if i is None or i % 2 else None, "src0", None, "x", "y") for i, t in rows]
        return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, key string, row string")
    return make
