"""Every registered query against its SQL, and the shape of those without SQL."""

import oracle
import pytest

from catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(name, spark, sf_dir, con):
    assert oracle.compare(QUERIES[name](spark, sf_dir), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(name, collected):
    """What these return is tested in test_fitted.py."""
    rows = collected(name)
    assert rows
    for row in rows:
        for column, value in row.items():
            if column.startswith("proba"):
                assert 0.0 <= value <= 1.0
            if column == "uplift_score":
                assert -1.0 <= value <= 1.0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
