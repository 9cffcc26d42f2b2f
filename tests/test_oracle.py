"""Every registered query against its DuckDB oracle on the driver's testdata."""

import pytest

import __spark_entry__ as E
from compare import compare
from paths import SF001, SF01

KEYS = sorted(E._core_queries())
SQL = E._core_oracle_sql()


def test_every_key_has_an_oracle():
    assert set(KEYS) == set(SQL)
    assert set(KEYS) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle_sf0_01(spark, duck01, key):
    df = E.queries()[key](spark, SF01)
    ok, msg = compare(df, duck01, SQL[key])
    assert ok, msg


@pytest.mark.parametrize("key", ["sel_flat", "graph_edges", "graph_nodes", "stacked_drilldown",
                                 "stacked_streamgraph_wide", "prep_events"])
def test_query_matches_oracle_sf0_001(spark, duck001, key):
    ok, msg = compare(E.queries()[key](spark, SF001), duck001, SQL[key])
    assert ok, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["source1", "source2", "eventsSharedCount", "meanToneDist"]
    assert df.count() > 0
