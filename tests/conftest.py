import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from secondpass.session import get_spark, release

    session = get_spark("tests", partitions=4)
    yield session
    release(session)
    session.stop()
