from __future__ import annotations

import os

import pytest

from codesift.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    session = local_session(os.environ.get("TEST_CPUS", "4"), 4)
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()
