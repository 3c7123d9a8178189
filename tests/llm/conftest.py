import pytest


@pytest.fixture
def docs(spark):
    """(doc_id, text) rows as a table with a clashing extra column."""

    def make(rows, extra=True):
        if not extra:
            return spark.createDataFrame([tuple(r) for r in rows], "doc_id bigint, text string")
        return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id bigint, text string, pieces int")

    return make
