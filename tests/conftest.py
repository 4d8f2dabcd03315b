import pytest

from plumbline.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session("local[4]", 4)
