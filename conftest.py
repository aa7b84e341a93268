"""Makes the repository importable for the tests and for Spark's Python workers."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark():
    from coppice.session import build_session

    extra = {"spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"}
    session = build_session("tests", **extra)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
