"""Every registered query equals its DuckDB oracle at sf0.01 (exact values)."""

import pytest

from __spark_entry__ import entry
from ledgerlens.plans.catalog import QUERIES
from ledgerlens.plans.oracle import ORACLE
from tests.conftest import SF01
from tests.oracle_harness import compare_query, duck_connection

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def duck():
    return duck_connection(SF01)


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    exact, _, msg = compare_query(spark, name, SF01, duck)
    assert exact, msg


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.columns == ["symbol", "transfer_filter", "month", "transfer_count", "raw_volume", "token_volume",
                          "unique_senders", "unique_receivers", "active_addresses"]
    assert df.count() > 0
