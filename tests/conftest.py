import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quantframe.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 8)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


@pytest.fixture
def rows():
    """Collect as a set of tuples with doubles rounded."""

    def collect(df, *columns, places=6):
        def tidy(v):
            return round(v, places) if isinstance(v, float) else v

        return sorted(
            (tuple(tidy(v) for v in r) for r in df.select(*columns).collect()), key=str
        )

    return collect
