import pytest
from strandgraph.plans import analytics, catalogue, deliveries, derivations, networks, registry, studies  # noqa: F401

from .oracle import connection, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


#: Without a form in SQL; test_algorithms.py compares them with plain loops.
BY_LOOPS = {"g10_communities", "g12_betweenness", "g16_linkage", "g17_cluster_choice"}


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL) | BY_LOOPS


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, con, name):
    assert spark_rows(registry.QUERIES[name](spark, SF)) == sql_rows(con, registry.SQL[name])
