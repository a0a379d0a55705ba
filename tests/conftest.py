import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]


@pytest.fixture(scope="session")
def spark():
    from blocklens.session import build_session
    session = build_session("local[8]", "blocklens-tests", 4, {"spark.driver.memory": "8g"})
    yield session
    session.stop()
