"""Registered queries against their SQL; the full list runs with `python -m tests.oracle <folder>`."""

import pytest

from tests.oracle import compare, duck
from wireloom.plans.catalog import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
SOME = ("gate_edges", "net_table", "check_floating_net", "cell_library", "levels", "scores", "block_summary", "cones", "carry_subject", "sessions",
        "repair_links", "link_consequences", "streamed_last_turns", "route_named", "sql_cell_functions")


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, DATA, QUERIES[name], ORACLE[name])[0] is None


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
