import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

from folioscope.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build("tests", "8", 4)
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a frame as a set of tuples in column order."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
