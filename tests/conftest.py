import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent.parent), str(Path(__file__).parent)]

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quillon.session import local_session

    return local_session("2", 4)


@pytest.fixture(scope="session")
def con():
    import oracle

    return oracle.connection(SF)


@pytest.fixture(scope="session")
def sf():
    return SF
