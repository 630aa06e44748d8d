import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from litloom.session import local_session

    session = local_session(4, 4)
    session.sparkContext.setLogLevel("OFF")
    from litloom.session import ship

    ship(session)
    yield session
    session.stop()
