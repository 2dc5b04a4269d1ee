import pytest

from evidara.session import build_session, ship_package


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cores=4, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    return session
