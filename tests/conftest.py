import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from segmill.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session(4, 4)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
