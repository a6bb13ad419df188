import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from logharrow.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        master="local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="4g",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


ARRIVED = datetime(2026, 12, 1, 12, 0, 0)


@pytest.fixture
def envelope(spark):
    """Envelope rows from lines, or from (line, tag) pairs."""
    from logharrow.schemas import ENVELOPE

    def make(*lines):
        rows = [
            ("192.0.2.1", None, tag, line, ARRIVED)
            for line, tag in (entry if isinstance(entry, tuple) else (entry, None) for entry in lines)
        ]
        return spark.createDataFrame(rows, ENVELOPE)

    return make
