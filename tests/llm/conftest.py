import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents-like table from (doc_id, text), with columns whose names clash with results."""

    def make(rows, more="n_shingles bigint, score double, spans string, ids string, component_id bigint"):
        extra = (None,) * len(more.split(","))
        return spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id bigint, text string, {more}")

    return make
