import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def spark():
    from geoverity.session import build_session
    yield build_session(master="local[4]", shuffle_partitions=4, app_name="llm-tests")


@pytest.fixture
def docs(spark):
    """Builds documents from (doc_id, text) rows, with extra and clashing columns."""
    def make(rows, more=""):
        cols = "doc_id long, text string, lang string, source string, n_chars long, k string, h long" + more
        return spark.createDataFrame(
            [(i, t, None, f"s{(i or 0) % 2}", None, "clash", 7, *rest) for i, t, *rest in rows], cols)
    return make
