import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from notewise.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("NOTEWISE_DRIVER_MEMORY", "4g")
    session = local_session(4, 4, "notewise-tests")
    yield session
    session.stop()
