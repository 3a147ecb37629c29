import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])
os.environ.setdefault("TIDEMARK_DRIVER_MEMORY", "6g")


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import get_session

    s = get_session(cores=8, partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"
