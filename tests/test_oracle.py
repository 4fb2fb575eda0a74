"""Every registered query against its SQL on the same tables."""

import pytest
from compare import DATA, connect, differences

import __spark_entry__ as contract

SF_DIR = f"{DATA}/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    df = contract.queries()[name](spark, SF_DIR)
    assert differences(df, con, contract.oracle_sql()[name]) == []


def test_entry_returns_the_report(spark):
    report = contract.entry(spark)
    assert report.columns == ["step", "name", "pct", "status", "code", "message"]
    assert report.count() == 5
