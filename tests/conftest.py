import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from aliasmith.session import local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_dir():
    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("generated tables are not here")
    return str(folder)
