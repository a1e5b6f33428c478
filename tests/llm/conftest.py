import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from made import ROWS, SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5, "doc_id")


@pytest.fixture(scope="session")
def plain():
    return [(r[0], r[1]) for r in ROWS]


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
