import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tradeloom import build_session

    session = build_session(
        "tests", "local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture(scope="session")
def folder():
    return os.environ.get("TRADELOOM_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def tables(spark, folder):
    from tradeloom.sources.star import StarTables

    return StarTables(spark, folder)
