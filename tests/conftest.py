from __future__ import annotations

import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark():
    from evispark import build_session

    session = build_session("tests", "*", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
