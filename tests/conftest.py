from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark():
    from quirelake.session import local_session, ship

    s = local_session(4, 4)
    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return "/root/testdata"
