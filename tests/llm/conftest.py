from pathlib import Path

import pytest

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def folder():
    if not Path(FOLDER).exists():
        pytest.skip("driver tables are not here")
    return FOLDER


#: Columns named like those that the operators add or use inside.
CLASH = "row long, fp long, body string, size string, shard string, key string, id string, words string, score string"


@pytest.fixture
def clash(spark):
    """A table of (doc_id, text) with further columns of clashing names."""

    def make(rows):
        rest = (1, 2, "b", "s", "t", "k", "i", "w", "c")
        return spark.createDataFrame([(*row, *rest) for row in rows], f"doc_id long, text string, {CLASH}").repartition(3)

    return make
