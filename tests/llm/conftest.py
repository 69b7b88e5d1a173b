import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    def make(rows):
        """rows: texts, or (doc_id, text) or (doc_id, text, lang); nulls stay."""
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            full.append((r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")))
        return spark.createDataFrame(full, DOCS)

    return make
