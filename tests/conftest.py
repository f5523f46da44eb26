import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from textlake.session import local_session
    session = local_session(int(os.environ.get("TEST_CPUS", "8")), "textlake-tests")
    yield session
    session.stop()


def rows(df, *cols):
    """Collected values, sorted."""
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=repr)
