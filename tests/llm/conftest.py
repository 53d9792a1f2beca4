import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def rows():
    from helpers import planted

    return planted()


@pytest.fixture(scope="session")
def docs(spark, rows):
    from helpers import table

    return table(spark, [*rows, rows[0], (None, rows[1][1], None, None, None)]).cache()


@pytest.fixture(scope="session")
def empty(spark):
    from helpers import table

    return table(spark, [])
