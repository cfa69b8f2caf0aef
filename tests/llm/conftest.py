import sys
from pathlib import Path

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


sys.path[:0] = [str(Path(__file__).parent)]


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts, or from (id, text) pairs."""

    def table(texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows], DOCS)

    return table
