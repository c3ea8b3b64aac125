import pytest

from plexgraph.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", 4, "4g", **{"spark.ui.showConsoleProgress": "false"})
    yield s
    s.stop()
