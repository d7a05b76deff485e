"""Every SQL-expressible registered query equals its DuckDB oracle on sf0.001 (names, rows, exact values)."""

import pytest

from __spark_entry__ import oracle_sql, queries
from tests import oracle_compare
from tests.conftest import SF_SMALL

NAMES = sorted(oracle_sql())


@pytest.fixture(scope="module")
def con():
    return oracle_compare.duck(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name, monkeypatch):
    monkeypatch.setattr(oracle_compare, "STRICT", True)
    ok, msg = oracle_compare.compare(spark, SF_SMALL, name, queries()[name], oracle_sql()[name], con)
    assert ok, msg


def test_every_query_has_oracle_or_is_model_fit():
    from carepath.plans.oracle import ORACLE_SQL
    from carepath.plans.queries import QUERIES

    assert set(QUERIES) - set(ORACLE_SQL) == {"final_report", "risk_codes_only", "risk_with_notes"}
