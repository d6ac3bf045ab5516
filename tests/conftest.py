import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from graphlog.storage import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    made = session("tests", 8, 4)
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
