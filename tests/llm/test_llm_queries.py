"""The registered text queries against their SQL, on whole tables."""

import oracle
import pytest

import __spark_entry__ as entry
from tidemark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(name, spark, sf_dir):
    assert oracle.compare(QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), ORACLES[name]) is None


def test_all_are_registered():
    names = entry.queries()
    assert [n for n in range(1, 14) if not any(k.startswith(f"op{n}_") for k in names)] == []
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_on_the_whole_table(name, spark, sf_dir):
    found = QUERIES[name](spark, sf_dir)
    if not name.startswith("op1_"):
        assert found.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
