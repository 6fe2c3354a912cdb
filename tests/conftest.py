from __future__ import annotations

import os

import pytest

os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(__file__)))


@pytest.fixture(scope="session")
def spark():
    from brightmill.session import build_session

    session = build_session("local[4]", 4, **{"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
