import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from twinframe.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "twinframe-tests")
