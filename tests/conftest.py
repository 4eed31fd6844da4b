from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lakejobs.session import build_session

    session = build_session(
        "tests",
        "local[8]",
        spark__ui__enabled="false",
        spark__driver__memory="4g",
        spark__sql__shuffle__partitions=4,
        spark__sql__warehouse__dir=tmp_path_factory.mktemp("warehouse"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def new_table(spark):
    """Names of tables that no other test uses; the tables go when the test ends."""
    import uuid

    names = []

    def name(label="t"):
        names.append(f"{label}_{uuid.uuid4().hex[:10]}")
        return names[-1]

    yield name
    for n in names:
        spark.sql(f"DROP TABLE IF EXISTS {n}")
