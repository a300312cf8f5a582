from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from attesta.session import local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("attesta-tests", 8)
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    # Its stand-ins run in the workers.
    session.sparkContext.addPyFile(str(Path(__file__).with_name("test_research.py")))
    yield session
    session.stop()
