import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a documents table from texts; ids count from 1."""

    def make(texts, source="s"):
        return spark.createDataFrame([(k, t, "en", source, len(t or "")) for k, t in enumerate(texts, 1)], SCHEMA)

    return make


@pytest.fixture(scope="session")
def sample_dir():
    return "/root/testdata/sf0.001"
