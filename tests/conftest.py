import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark():
    from barloom.session import build_session

    s = build_session("tests", "8")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import check

    return check.duck("/root/testdata/sf0.001")
