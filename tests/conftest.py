import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quirefold.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("quirefold-tests", master="local[8]")
    session.conf.set("spark.sql.shuffle.partitions", "8")
    yield session
    session.stop()
