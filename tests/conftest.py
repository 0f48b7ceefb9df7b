import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from waymill.session import session

    s = session("4", "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
