import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with further columns whose names the operators use themselves."""

    def make(rows):
        schema = "doc_id long, text string, key string, kept string, digest string, fp string, shard string, score string, row string, length int"
        return spark.createDataFrame([(i, t, "k", "x", None, "f", "s", "0.9", "r", 7) for i, t in rows], schema)

    return make
