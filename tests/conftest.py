import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from brickyard.session import build_session

    session = build_session("tests", shuffle_partitions=4)
    yield session
    session.stop()
