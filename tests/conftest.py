import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from kerbline.session import build_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "kerbline-tests",
        "local[8]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="6g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def sf_dir():
    return SF_DIR


@pytest.fixture
def force_large(monkeypatch):
    """Make every table count as too large to broadcast, so the other way is taken."""
    from kerbline.operators import graph, lookup, retrieval

    for module in (lookup, retrieval):
        monkeypatch.setattr(module, "fits_broadcast", lambda *args, **kwargs: False)
    for module in (graph, retrieval):
        monkeypatch.setattr(module, "measured", lambda df, *args: (df.count(), False))
