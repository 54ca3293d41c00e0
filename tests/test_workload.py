"""Every registered query against its SQL on the smallest data."""

from __future__ import annotations

import pytest

import __spark_entry__
from tests.conftest import SMALL
from tools.compare import differences, duck
from workload.oracles import ORACLES
from workload.queries import QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


#: Models that SQL cannot fit; tests of their own hold their figures.
NO_SQL = {"language_classifier", "term_space", "document_clusters"}


def test_every_query_has_its_sql():
    assert set(QUERIES) - NO_SQL == set(ORACLES)
    assert set(QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    assert differences(spark, con, SMALL, name) == []


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert {r["Target_Tier"] for r in rows} == {"Tier_1_Local", "Tier_2_API"}
