import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from rostrum.session import build_session

    session = build_session("tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tiny_blocks(monkeypatch):
    """Treat every key as long and cut it into blocks of a few rows."""
    from rostrum.operators import tree
    from rostrum.plans import ordered

    monkeypatch.setattr(ordered, "LONG_KEY_ROWS", 10)
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 8)
    monkeypatch.setattr(tree, "LOCAL_NODE_ROWS", 12)
