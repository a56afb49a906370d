import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tidecast.session import ensure_local_checkpoint_dir, local_session

    s = local_session("*", 8, app="tidecast-tests")
    ensure_local_checkpoint_dir(s)
    yield s
    s.stop()
