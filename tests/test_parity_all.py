"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry
from tests.parity import compare, connect
from textlake.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    assert compare(spark, con, key, QUERIES, ORACLES, SF) == ""


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["c_mktsegment", "balance", "n"]
    assert df.count() > 0


def test_only_the_iterative_clustering_has_no_sql():
    assert set(QUERIES) - set(ORACLES) == {"sem_11_cluster_by_similarity"}
