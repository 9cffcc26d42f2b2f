"""Invariants of the graph and the stacked series on FX1 (sf0.01)."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from compare import rows_of_spark
from paths import SF01
from outletlens.operators import graph, selection, stacked
from outletlens.operators.prepare import prepare
from outletlens.session import materialise
from outletlens.sources.fixtures import fx1_tables


@pytest.fixture(scope="module")
def flat(spark):
    return materialise(selection.select_flat(fx1_tables(spark, SF01), E.P1))


@pytest.fixture(scope="module")
def parts(flat):
    pr = prepare(flat)
    return graph.graph(pr.mentions), stacked.stacked(pr.full), pr


def test_edges_canonical_and_counts_add_up(parts):
    g, _, _ = parts
    assert g["edge_events"].where("source1 >= source2").count() == 0
    total = g["edges"].agg(F.sum("eventsSharedCount")).first()[0]
    assert total == g["edge_events"].count()


def test_each_event_adds_k_choose_2_pairs(parts):
    g, _, pr = parts
    tone = graph.outlet_tone(pr.mentions)
    k = graph.filtered(tone, graph.top_sources(tone)).groupBy("eventId").agg(F.count(F.lit(1)).alias("k"))
    expected = k.agg(F.sum(F.col("k") * (F.col("k") - 1) / 2)).first()[0]
    assert g["edge_events"].count() == expected


def test_streamgraph_total_equals_degree_total_of_top_outlets(parts):
    _, s, pr = parts
    dd = stacked.hour_dedup(pr.full)
    dom = stacked.dom_outlets(dd)
    deg = stacked.outlet_degree(dd).join(dom.select("mentionSourceName"), "mentionSourceName")
    want = deg.agg(F.sum("numOtherSources")).first()[0]
    assert s["streamgraph"].agg(F.sum("numOtherSources")).first()[0] == want
    wide = s["streamgraph_wide"]
    assert wide.agg(sum(F.sum(f"outlet_{i}") for i in range(1, 11))).first()[0] == want


def test_permuting_input_rows_changes_nothing(spark, flat, parts):
    g, s, _ = parts
    shuffled = flat.repartition(7, F.rand(seed=3)).sortWithinPartitions(F.rand(seed=5))
    pr2 = prepare(shuffled)
    g2, s2 = graph.graph(pr2.mentions), stacked.stacked(pr2.full)
    for name in ("edges", "edge_events", "nodes"):
        assert rows_of_spark(g2[name]) == rows_of_spark(g[name]), name
    for name in ("drilldown", "streamgraph", "dates"):
        assert rows_of_spark(s2[name]) == rows_of_spark(s[name]), name
