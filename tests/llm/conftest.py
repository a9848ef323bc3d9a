import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from llm_data import DOCS, prose  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, ties, repeated rows, long texts, and columns whose names operators use inside."""
    rows = [(1, None), (2, ""), (3, " \t\n\r\x0b\x0c"), (4, "é"), (None, "no id here"), (5, prose(30_000, 1)), (6, prose(80, 2)), (6, prose(80, 2)), (7, prose(80, 2)), (8, "A" * 200_000), (9, "\x00 \U0001f600 ok"), (10, "x\n" * 3000)]
    return spark.createDataFrame([(i, t, None, None, None, "n", 1, 2, 3) for i, t in rows], DOCS + ", node string, row int, spans int, component int")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
