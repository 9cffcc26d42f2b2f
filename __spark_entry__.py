"""

Every query reads the driver's testdata through a fixture mapping (FX1 from
``events``; FX3 = FX1 with a third of the mentions on one hot event; FX2 from
``lineitem`` x ``orders``) and runs the full plan over the whole tables;
``oracle_sql`` holds the DuckDB equivalent of each key (all but the two nested
outputs). Key groups: ``sel_*`` selection, ``prep_*`` split, ``graph_*``
co-coverage graph, ``stacked_*`` hourly series, ``ex_*`` example task,
``hot_*`` skew fixture, ``fx2_*`` many small events, ``batch_*`` several
datasets in one keyed job, and round trips through sinks and the cache.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outletlens import oracle as O
from outletlens.functions.exprs import cents_to_double
from outletlens.operators import example, graph, selection, stacked
from outletlens.operators.prepare import prepare
from outletlens.params import Params
from outletlens.session import materialise
from outletlens.sources.fixtures import FIXTURES

# the training-data operators and their pipeline are optional parts of the repository
try:
    import corpus_pipeline
    from outletlens.llm import queries as llm
except ModuleNotFoundError as missing:
    if missing.name not in ("outletlens.llm", "corpus_pipeline"):
        raise
    llm = corpus_pipeline = None

# Parameter sets of the fixture queries (FIXTURES.md: P1, P2; FX2 volume set).
P1 = Params("2024-01-05T00:00:00.000Z", "2024-01-12T00:00:00.000Z", 10, 50, 100000, "")
P2 = Params("2024-01-05T06:00:00.000Z", "2024-01-12T12:00:00.000Z", 10, 50, 100000,
            "click|purchase")
P1_LIMITED = P1.with_(limit=500)
EMPTY = Params()  # the reference's default window (2018): no fixture data in it
# a limit that falls among many events of one source count
FX2 = Params("1995-03-01T00:00:00.000Z", "1998-03-01T00:00:00.000Z", 1, 0, None, "")

# dataset names may hold any character a file name may
FIRST, SECOND = "p1_5th_->_12th", "p 2 +50%"

FX2_TIES = FX2.with_(limit=500)
SMOKE_DIR = "/root/testdata/sf0.001"


# --- building blocks --------------------------------------------------------------

def _tables(spark, sf_dir, fixture="fx1"):
    return FIXTURES[fixture](spark, sf_dir)


def _flat(spark, sf_dir, p=P1, fixture="fx1"):
    return selection.select_flat(_tables(spark, sf_dir, fixture), p)


def _prep(spark, sf_dir, p=P1, fixture="fx1"):
    """Analyses start from the selection computed once (checkpointed), as in the
    pipeline, instead of re-planning it for every consumer."""
    return prepare(materialise(_flat(spark, sf_dir, p, fixture)))


def _tone_double(df: DataFrame) -> DataFrame:
    return df.withColumn("avgTone", cents_to_double("avgToneCents")).drop("avgToneCents")


def _graph_stage(spark, sf_dir, p=P1, fixture="fx1"):
    m = _prep(spark, sf_dir, p, fixture).mentions
    tone = graph.outlet_tone(m)
    top = graph.top_sources(tone)
    filt = graph.filtered(tone, top)
    return tone, top, filt, graph.pairs(filt)


def _dedup(spark, sf_dir, p=P1, fixture="fx1"):
    return stacked.hour_dedup(_prep(spark, sf_dir, p, fixture).full)


# --- queries ------------------------------------------------------------------------

def q_sel_event_ids(spark, d, p=P1):
    return selection.distinct_event_ids(_tables(spark, d).mentions, p)


def q_sel_events_semi(spark, d, p=P1):
    t = _tables(spark, d)
    return selection.events_in_window(t.events, selection.event_ids(t.mentions, p), p)


def q_sel_best_events(spark, d, p=P1):
    t = _tables(spark, d)
    return selection.best_events(selection.confident_mentions(t.mentions, p), p)


def q_sel_mentions_of_best(spark, d, p=P1):
    t = _tables(spark, d)
    conf = selection.confident_mentions(t.mentions, p)
    return selection.mentions_of_best(conf, selection.best_events(conf, p), p)


def q_sel_empty_guard(spark, d):
    parts = [selection.empty_guard(_flat(spark, d, p)).select(F.lit(name).alias("param_set"), "empty")
             for name, p in (("P1", P1), ("default", EMPTY))]
    return parts[0].unionByName(parts[1])


def q_graph_outlet_tone(spark, d):
    return _tone_double(_graph_stage(spark, d)[0])


def q_graph_filtered(spark, d):
    return _tone_double(_graph_stage(spark, d)[2])


def q_graph_edges(spark, d, p=P1, fixture="fx1"):
    return graph.edges(_graph_stage(spark, d, p, fixture)[3])


def q_graph_nodes(spark, d):
    return graph.nodes(_graph_stage(spark, d)[2])


def q_graph_totals(spark, d):
    return graph.totals(graph.edges(_graph_stage(spark, d)[3]))


def q_stacked_outlet_degree_tone(spark, d, p=P1):
    return stacked.outlet_degree_tone(_dedup(spark, d, p))


def q_stacked_streamgraph(spark, d, wide=False):
    dd = _dedup(spark, d)
    f = stacked.streamgraph_wide if wide else stacked.streamgraph_long
    return f(dd, stacked.dom_outlets(dd))


def q_stacked_drilldown(spark, d, p=P1, nested=False, fixture="fx1"):
    dd = _dedup(spark, d, p, fixture)
    out = stacked.drilldown(dd, stacked.dom_outlets(dd))
    return stacked.drilldown_nested(out) if nested else out


def q_ex_best_mentions(spark, d):
    pr = _prep(spark, d)
    return example.best_mentions(pr.mentions, example.best_events(pr.events))


def _two_datasets(spark, d):
    """Two saved datasets (P1, P2) for the keyed batch plan."""
    return {FIRST: _flat(spark, d, P1), SECOND: _flat(spark, d, P2)}


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: edges of the co-coverage graph on sf0.001 (min sources 3 there)."""
    return q_graph_edges(spark, SMOKE_DIR, P1.with_(minimum_distinct_source_count=3))


def _core_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from outletlens.plans import plumbing as PL  # I/O keys (write, then read back)
    from outletlens.plans.tasks import ExampleTask, GraphTask, StackedGraphTask

    return {
        # selection
        "sel_event_ids": q_sel_event_ids,
        "sel_events_semi": q_sel_events_semi,
        "sel_best_events": q_sel_best_events,
        "sel_mentions_of_best": q_sel_mentions_of_best,
        "sel_flat": lambda s, d: _flat(s, d, P1),
        "sel_flat_p2": lambda s, d: _flat(s, d, P2),
        "sel_flat_limited": lambda s, d: _flat(s, d, P1_LIMITED),
        "sel_flat_restrict": lambda s, d: selection.select_flat(_tables(s, d), P1, strategy="restrict"),
        "sel_flat_p2_fold": lambda s, d: selection.select_flat(_tables(s, d), P2, strategy="fold"),
        "sel_event_ids_p2": lambda s, d: q_sel_event_ids(s, d, P2),
        "sel_empty_guard": q_sel_empty_guard,
        # preparation
        "prep_events": lambda s, d: _prep(s, d).events,
        "prep_mentions": lambda s, d: _prep(s, d).mentions,
        # graph
        "graph_outlet_tone": q_graph_outlet_tone,
        "graph_top_sources": lambda s, d: _graph_stage(s, d)[1],
        "graph_filtered": q_graph_filtered,
        "graph_pairs": lambda s, d: _graph_stage(s, d)[3],
        "graph_edge_events": lambda s, d: graph.edge_events(_graph_stage(s, d)[3]),
        "graph_edges": q_graph_edges,
        "graph_edges_p2": lambda s, d: q_graph_edges(s, d, P2),
        "graph_totals": q_graph_totals,
        "graph_nodes": q_graph_nodes,
        # nested documents, taken apart again
        "graph_edges_nested": lambda s, d: graph.edges_nested(q_graph_edges(s, d)).select(
            "source1", F.explode("targets").alias("source2", "t")).select("source1", "source2", "t.*"),
        "graph_nodes_nested": lambda s, d: graph.nodes_nested(q_graph_nodes(s, d)).select(
            F.explode("nodes").alias("mentionSourceName", "n")).select("mentionSourceName", "n.*"),
        # stacked series
        "stacked_hour_dedup": lambda s, d: _dedup(s, d),
        "stacked_dates": lambda s, d: stacked.dates(_dedup(s, d)),
        "stacked_num_other": lambda s, d: stacked.num_other_sources(_dedup(s, d)),
        "stacked_num_other_tone": lambda s, d: stacked.num_other_sources(_dedup(s, d), with_tone=True),
        "stacked_outlet_degree": lambda s, d: stacked.outlet_degree(_dedup(s, d)),
        "stacked_outlet_degree_tone": q_stacked_outlet_degree_tone,
        "stacked_outlet_degree_tone_p2": lambda s, d: q_stacked_outlet_degree_tone(s, d, P2),
        "stacked_dom_outlets": lambda s, d: stacked.dom_outlets(_dedup(s, d)),
        "stacked_streamgraph_long": q_stacked_streamgraph,
        "stacked_streamgraph_wide": lambda s, d: q_stacked_streamgraph(s, d, wide=True),
        "stacked_drilldown": q_stacked_drilldown,
        "stacked_drilldown_p2": lambda s, d: q_stacked_drilldown(s, d, P2),
        "stacked_drilldown_nested": lambda s, d: q_stacked_drilldown(s, d, nested=True).select(
            "mentionSourceName", F.inline("records")),
        "stacked_streamgraph_nested": lambda s, d: stacked.streamgraph_nested(q_stacked_streamgraph(s, d)).select(
            "mentionInterval", F.explode("outlets").alias("mentionSourceName", "numOtherSources")),
        # example task
        "ex_best_events": lambda s, d: example.best_events(_prep(s, d).events),
        "ex_best_mentions": q_ex_best_mentions,
        # volume fixture (many small events)
        "fx2_sel_flat": lambda s, d: _flat(s, d, FX2, "fx2"),
        "fx2_sel_flat_limited": lambda s, d: _flat(s, d, FX2_TIES, "fx2"),
        "fx2_graph_edges": lambda s, d: q_graph_edges(s, d, FX2, "fx2"),
        "fx2_graph_nodes": lambda s, d: graph.nodes(_graph_stage(s, d, FX2, "fx2")[2]),
        # skew fixture: a third of all mentions on one event
        "hot_sel_flat": lambda s, d: _flat(s, d, P1, "fx3"),
        "hot_sel_flat_p2": lambda s, d: _flat(s, d, P2, "fx3"),
        "hot_graph_edges": lambda s, d: q_graph_edges(s, d, P1, "fx3"),
        "hot_stacked_drilldown": lambda s, d: q_stacked_drilldown(s, d, P1, fixture="fx3"),
        # plumbing
        "task_registry": lambda s, d: PL.task_registry(s, _flat(s, d, P1)),
        "batch_datasets": lambda s, d: PL.batch_datasets(s, _two_datasets(s, d)),
        "batch_graph_nodes": lambda s, d: PL.batch_datasets(s, _two_datasets(s, d), "graph", "nodes"),
        "batch_stacked_drilldown": lambda s, d: PL.batch_datasets(s, _two_datasets(s, d),
                                                                  "stackedGraph", "drilldown"),
        "batch_stacked_streamgraph": lambda s, d: PL.batch_datasets(s, _two_datasets(s, d),
                                                                    "stackedGraph", "streamgraph"),
        "io_csv_roundtrip": lambda s, d: PL.csv_roundtrip(s, _flat(s, d, P1).withColumn(
            "mentionIdentifier", F.concat(F.lit("  "), "mentionIdentifier", F.lit('a"b,c\nd \\ ')))),
        "io_json_roundtrip": lambda s, d: PL.json_roundtrip(s, q_stacked_drilldown(s, d)),
        "io_json_nested": lambda s, d: PL.nested_json_roundtrip(s, q_stacked_drilldown(s, d, nested=True)),
        "cache_hit": lambda s, d: PL.cache_hit(s, _tables(s, d), P1, f"fx1:{d}"),
        # other tables under the name of cached ones: served from the cache, unless refreshed
        "cache_served": lambda s, d: PL.cache_hit(s, _tables(s, d), P1, "same name", _tables(s, d, "fx3")),
        # files appended between two runs under one name
        "cache_appended": lambda s, d: PL.cache_appended(s, _tables(s, d), P1, "same name"),
        # one nested document, taken apart again
        "graph_document": lambda s, d: PL.graph_document(s, _flat(s, d, P1)),
        "graph_document_edges": lambda s, d: PL.graph_document(s, _flat(s, d, P1), "edges"),
        "hot_graph_document": lambda s, d: PL.graph_document(s, _flat(s, d, P1, "fx3")),
        # presentation orders, with each row's place
        "io_ordered_nodes": lambda s, d: PL.ordered_part(s, _flat(s, d, P1), GraphTask(), "nodes"),
        "io_ordered_mentions": lambda s, d: PL.ordered_part(s, _flat(s, d, P1), ExampleTask(), "mentions"),
        "io_ordered_dates": lambda s, d: PL.ordered_part(s, _flat(s, d, P1), StackedGraphTask(), "dates"),
        "io_ordered_edges": lambda s, d: PL.ordered_part(s, _flat(s, d, P1), GraphTask(), "edges"),
        # both tables bucketed by event
        "sel_flat_bucketed": lambda s, d: PL.bucketed_selection(s, _tables(s, d), P1),
        "hot_sel_flat_bucketed": lambda s, d: PL.bucketed_selection(s, _tables(s, d, "fx3"), P2),
        # datasets whose files arrive in two runs
        "batch_incremental": lambda s, d: PL.batch_incremental(s, _two_datasets(s, d)),
        "batch_incremental_drilldown": lambda s, d: PL.batch_incremental(s, _two_datasets(s, d), "stackedGraph", "drilldown"),
        "cache_refreshed": lambda s, d: PL.cache_hit(s, _tables(s, d), P1, "same name", _tables(s, d, "fx3"), refresh=True),
    }


def _core_oracle_sql() -> dict[str, str]:
    W = O.with_ctes
    bodies = O.event_bodies(P1)
    flat_cols = "SELECT * FROM flat"
    tone_cols = ("SELECT eventId, mentionSourceName, CAST(cents AS DOUBLE) / 100 AS avgTone, "
                 "mentionIdentifier FROM {}")
    edge_events = ("SELECT source1, source2, eventId, CAST(avgTone1Cents AS DOUBLE) / 100 AS avgTone1, "
                   "CAST(avgTone2Cents AS DOUBLE) / 100 AS avgTone2, url1, url2 FROM pairs")
    edges = "SELECT * FROM edges"
    drilldown = 'SELECT mentionSourceName, mentionInterval, "true", "false" FROM dd'
    nodes = ("SELECT mentionSourceName, count(*) AS mentionnedEventsCount, "
             "CAST(CAST(round_even(avg(cents), 0) AS BIGINT) AS DOUBLE) / 100 AS avgTone "
             "FROM filt GROUP BY mentionSourceName")
    documents = ("SELECT mentionSourceName, strftime(mentionInterval, '%Y-%m-%dT%H:%M:%SZ') AS mentionInterval, "
                 '"true", "false" FROM dd')
    streamgraph = "SELECT mentionInterval, mentionSourceName, numOtherSources FROM sg_long"

    def batch(body: str, **kw) -> str:
        return ("SELECT * FROM (" + W(P1, f"SELECT '{FIRST}' AS dataset, * FROM ({body})", **kw)
                + ")\nUNION ALL\nSELECT * FROM ("
                + W(P2, f"SELECT '{SECOND}' AS dataset, * FROM ({body})", **kw) + ")")
    return {
        "sel_event_ids": W(P1, bodies["ids"]),
        "sel_events_semi": W(P1, bodies["events"]),
        "sel_best_events": W(P1, bodies["best"]),
        "sel_mentions_of_best": W(P1, bodies["mentions"]),
        "sel_flat": W(P1, flat_cols),
        "sel_flat_p2": W(P2, flat_cols),
        "sel_flat_limited": W(P1_LIMITED, flat_cols),
        "sel_flat_restrict": W(P1, flat_cols),
        "sel_flat_p2_fold": W(P2, flat_cols),
        "sel_event_ids_p2": W(P2, O.event_bodies(P2)["ids"]),
        "sel_empty_guard": (
            W(P1, "SELECT 'P1' AS param_set, NOT EXISTS (SELECT 1 FROM flat) AS empty")
            + "\nUNION ALL\n"
            + "(" + W(EMPTY, "SELECT 'default' AS param_set, NOT EXISTS (SELECT 1 FROM flat) AS empty") + ")"),
        "prep_events": W(P1, "SELECT * FROM prep_ev", prep=True),
        "prep_mentions": W(P1, "SELECT * FROM prep_m", prep=True),
        "graph_outlet_tone": W(P1, tone_cols.format("tone"), graph=True),
        "graph_top_sources": W(P1, "SELECT * FROM top_src", graph=True),
        "graph_filtered": W(P1, tone_cols.format("filt"), graph=True),
        "graph_pairs": W(P1, "SELECT * FROM pairs", graph=True),
        "graph_edge_events": W(P1, edge_events, graph=True),
        "graph_edges": W(P1, edges, graph=True),
        "graph_edges_p2": W(P2, edges, graph=True),
        "graph_edges_nested": W(P1, edges, graph=True),
        "graph_nodes_nested": W(P1, nodes, graph=True),
        "graph_totals": W(P1, "SELECT max(meanToneDist) AS maxToneDist, "
                              "max(eventsSharedCount) AS maxSharedEventsCount FROM edges", graph=True),
        "graph_nodes": W(P1, nodes, graph=True),
        "stacked_hour_dedup": W(P1, "SELECT * FROM dedup", stacked=True),
        "stacked_dates": W(P1, "SELECT DISTINCT roundedMentionDate AS mentionInterval, "
                               "strftime(roundedMentionDate, '%Y-%m-%d %H:%M:%SZ') AS label FROM dedup",
                           stacked=True),
        "stacked_num_other": W(P1, "SELECT * FROM nos", stacked=True),
        "stacked_num_other_tone": W(P1, "SELECT * FROM nos_tone", stacked=True),
        "stacked_outlet_degree": W(P1, "SELECT * FROM degree", stacked=True),
        "stacked_outlet_degree_tone": W(P1, "SELECT * FROM degree_tone", stacked=True),
        "stacked_outlet_degree_tone_p2": W(P2, "SELECT * FROM degree_tone", stacked=True),
        "stacked_dom_outlets": W(P1, "SELECT * FROM dom", stacked=True),
        "stacked_streamgraph_long": W(P1, streamgraph, stacked=True),
        "stacked_streamgraph_wide": W(P1, O.wide_body(), stacked=True),
        "stacked_drilldown": W(P1, drilldown, stacked=True),
        "stacked_drilldown_nested": W(P1, drilldown, stacked=True),
        "stacked_streamgraph_nested": W(P1, streamgraph, stacked=True),
        "stacked_drilldown_p2": W(P2, drilldown, stacked=True),
        "ex_best_events": W(P1, "SELECT * FROM prep_ev ORDER BY eventSourceCount DESC NULLS LAST, "
                                "eventId LIMIT 10", prep=True),
        "ex_best_mentions": W(P1, "SELECT * FROM prep_m WHERE eventId IN (SELECT eventId FROM prep_ev "
                                  "ORDER BY eventSourceCount DESC NULLS LAST, eventId LIMIT 10)", prep=True),
        "fx2_sel_flat": W(FX2, flat_cols, fixture="fx2"),
        "fx2_sel_flat_limited": W(FX2_TIES, flat_cols, fixture="fx2"),
        "fx2_graph_edges": W(FX2, edges, fixture="fx2", graph=True),
        "fx2_graph_nodes": W(FX2, nodes, fixture="fx2", graph=True),
        "hot_sel_flat": W(P1, flat_cols, fixture="fx3"),
        "hot_sel_flat_p2": W(P2, flat_cols, fixture="fx3"),
        "hot_graph_edges": W(P1, edges, fixture="fx3", graph=True),
        "hot_stacked_drilldown": W(P1, drilldown, fixture="fx3", stacked=True),
        "batch_datasets": batch(edges, graph=True),
        "batch_graph_nodes": batch(nodes, graph=True),
        "batch_stacked_drilldown": batch(drilldown, stacked=True),
        "batch_stacked_streamgraph": batch(streamgraph, stacked=True),
        "io_csv_roundtrip": W(P1, "SELECT * REPLACE ('  ' || mentionIdentifier || 'a\"b,c' || chr(10) || 'd \\ ' "
                                  "AS mentionIdentifier) FROM flat"),
        "io_json_roundtrip": W(P1, documents, stacked=True),
        "io_json_nested": W(P1, documents, stacked=True),
        "cache_hit": W(P1, edges, graph=True),
        "cache_served": W(P1, edges, graph=True),
        "cache_appended": W(P1, edges, graph=True),
        "graph_document": W(P1, edge_events, graph=True),
        "graph_document_edges": W(P1, edges, graph=True),
        "hot_graph_document": W(P1, edge_events, fixture="fx3", graph=True),
        "io_ordered_nodes": W(P1, f"SELECT *, row_number() OVER (ORDER BY mentionnedEventsCount DESC, mentionSourceName) AS rank FROM ({nodes})",
                              graph=True),
        "io_ordered_mentions": W(P1, "SELECT *, row_number() OVER (ORDER BY eventId, mentionDateAdded, mentionSourceName NULLS FIRST, "
                                     "mentionIdentifier NULLS FIRST, mentionDocTone NULLS FIRST) AS rank "
                                     "FROM prep_m WHERE eventId IN (SELECT eventId FROM prep_ev "
                                     "ORDER BY eventSourceCount DESC NULLS LAST, eventId LIMIT 10)", prep=True),
        "io_ordered_dates": W(P1, "SELECT mentionInterval, strftime(mentionInterval, '%Y-%m-%d %H:%M:%SZ') AS label, "
                                  "row_number() OVER (ORDER BY mentionInterval) AS rank "
                                  "FROM (SELECT DISTINCT roundedMentionDate AS mentionInterval FROM dedup)", stacked=True),
        "io_ordered_edges": W(P1, "SELECT *, row_number() OVER (ORDER BY source1, source2) AS rank FROM edges", graph=True),
        "sel_flat_bucketed": W(P1, flat_cols),
        "hot_sel_flat_bucketed": W(P2, flat_cols, fixture="fx3"),
        "batch_incremental": batch(edges, graph=True),
        "batch_incremental_drilldown": batch(drilldown, stacked=True),
        "cache_refreshed": W(P1, edges, fixture="fx3", graph=True),
        "task_registry": W(P1, """
SELECT 'graph' AS task, 'edges' AS part, count(*) AS "rows" FROM edges
UNION ALL SELECT 'graph', 'edge_events', count(*) FROM pairs
UNION ALL SELECT 'graph', 'nodes', count(DISTINCT mentionSourceName) FROM filt
UNION ALL SELECT 'graph', 'totals', 1
UNION ALL SELECT 'graph', 'edges_nested', count(DISTINCT source1) FROM edges
UNION ALL SELECT 'graph', 'nodes_nested', 1
UNION ALL SELECT 'stackedGraph', 'dates', count(DISTINCT roundedMentionDate) FROM dedup
UNION ALL SELECT 'stackedGraph', 'dom_outlets', count(*) FROM dom
UNION ALL SELECT 'stackedGraph', 'streamgraph', count(*) FROM sg_long
UNION ALL SELECT 'stackedGraph', 'streamgraph_wide', count(DISTINCT mentionInterval) FROM sg_long
UNION ALL SELECT 'stackedGraph', 'streamgraph_nested', count(DISTINCT mentionInterval) FROM sg_long
UNION ALL SELECT 'stackedGraph', 'drilldown', count(*) FROM dd
UNION ALL SELECT 'stackedGraph', 'drilldown_nested', count(DISTINCT mentionSourceName) FROM dd
UNION ALL SELECT 'ExampleTask', 'best_events', least(10, count(*)) FROM prep_ev
UNION ALL SELECT 'ExampleTask', 'mentions', count(*) FROM prep_m WHERE eventId IN (
  SELECT eventId FROM prep_ev ORDER BY eventSourceCount DESC NULLS LAST, eventId LIMIT 10)""",
                           graph=True, stacked=True),
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All registered queries: each takes the session and a data folder."""
    return _core_queries() | ({**llm.QUERIES, "pipeline": corpus_pipeline.run} if llm else {})


def oracle_sql() -> dict[str, str]:
    """The DuckDB statement of each query that SQL can express."""
    extra = dict(llm.ORACLE_SQL) if llm else {}
    if llm and corpus_pipeline.ORACLE_SQL:
        extra["pipeline"] = corpus_pipeline.ORACLE_SQL
    return _core_oracle_sql() | extra
