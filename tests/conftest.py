import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pagetext.session import build_session, shared_dir
    s = build_session(master="local[4]", shuffle_partitions=4, driver_memory="4g")
    shared_dir(s)   # tests set their own shared folder (unset in local runs)
    yield s
    s.stop()
