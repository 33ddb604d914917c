import datetime as dt

import pytest

from riskgrid.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=3, app="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def day():
    """date(2021, 6, 1) from "2021-06-01"."""
    return dt.date.fromisoformat
