import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session

    session = local_session(4, shuffle_partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def rows(spark):
    """Builds a frame from tuples and a DDL schema."""
    return lambda data, schema: spark.createDataFrame(data, schema)


@pytest.fixture
def table():
    """Collects a frame as a sorted list of tuples."""

    def collect(df, *cols):
        chosen = df.select(*cols) if cols else df
        return sorted((tuple(r) for r in chosen.collect()), key=str)

    return collect


@pytest.fixture(scope="session")
def collected(spark, sf_dir):
    """Rows of a registered query, run once for all tests."""
    from catalog import QUERIES

    kept = {}

    def rows(name):
        if name not in kept:
            kept[name] = [r.asDict() for r in QUERIES[name](spark, sf_dir).collect()]
        return kept[name]

    return rows
