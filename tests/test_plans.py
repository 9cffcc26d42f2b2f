"""Physical-plan properties: pruning, pushdown, join strategies, no Python UDF."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from compare import rows_of_spark
from paths import SF001
from outletlens.functions import keyed
from outletlens.operators import graph, selection, stacked
from outletlens.operators.prepare import prepare
from outletlens.plans.plumbing import bucketed_tables
from outletlens.session import materialise
from outletlens.sources.fixtures import fx1_tables, fx2_tables, stage


def plan(df) -> str:
    """Formatted physical plan (public ``explain`` output, captured)."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def staged(spark):
    return stage(spark, "fx1", SF001)


def test_partition_pruning_and_pushdown(staged):
    formatted = plan(selection.select_flat(staged, E.P2))
    assert "PartitionFilters: [isnotnull(part_day" in formatted
    assert "GreaterThanOrEqual(Confidence,50)" in formatted
    ids = plan(selection.distinct_event_ids(staged.mentions, E.P2))   # the id search job
    assert "PartitionFilters: [isnotnull(part_day" in ids
    assert "LessThanOrEqual(EventTimeDate,20240112120000)" in ids


def test_scan_reads_only_needed_columns(staged):
    ids = selection.distinct_event_ids(staged.mentions, E.P1)
    text = plan(ids)
    assert "ReadSchema: struct<GLOBALEVENTID:bigint,EventTimeDate:bigint>" in text


def test_semi_join_for_event_ids(staged):
    ev = selection.events_in_window(staged.events, selection.event_ids(staged.mentions, E.P1), E.P1)
    assert "LeftSemi" in plan(ev)


def test_no_python_udf_no_cartesian(spark):
    q = E.queries()
    for key in ["sel_flat", "graph_edges", "graph_edge_events", "stacked_drilldown",
                "stacked_streamgraph_long", "stacked_streamgraph_wide", "ex_best_mentions"]:
        text = plan(q[key](spark, SF001))
        for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct",
                    "BroadcastNestedLoopJoin"):
            assert bad not in text, (key, bad)


def test_pairs_join_is_equi_join_with_theta_residual(spark, staged):
    flat = selection.select_flat(staged, E.P1)
    tone = graph.outlet_tone(prepare(flat).mentions)
    pr = graph.pairs(graph.filtered(tone, graph.top_sources(tone)))
    text = plan(pr)
    assert ("SortMergeJoin" in text or "BroadcastHashJoin" in text)
    assert "Join condition: (source1#" in text and "< source2#" in text


def test_top_lists_are_broadcast(spark, staged):
    flat = selection.select_flat(staged, E.P1)
    tone = graph.outlet_tone(prepare(flat).mentions)
    filt = graph.filtered(tone, graph.top_sources(tone))
    assert "BroadcastHashJoin LeftSemi" in plan(filt).replace("\n", " ") or "BroadcastExchange" in plan(filt)


@pytest.fixture()
def no_auto_broadcast(spark):
    """Plans as on large inputs: no size-based broadcast, only explicit hints."""
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def tree_ops(text: str, op: str) -> int:
    """Occurrences of an operator in the plan tree (not the details section)."""
    return len(re.findall(rf"\+- {op}\b", text))


def test_regex_plan_has_one_join_and_no_broadcast_hint(staged, no_auto_broadcast):
    text = plan(selection.select_flat(staged, E.P2.with_(limit=None)))
    assert "BroadcastHashJoin" not in text                        # ids were written, no hint
    assert tree_ops(text, "SortMergeJoin") == 1                   # one join over the mentions


def test_fold_plan_has_one_mention_join_and_no_id_search(staged, no_auto_broadcast):
    text = plan(selection.select_flat(staged, E.P1.with_(limit=None)))
    assert "LeftSemi" not in text
    assert tree_ops(text, "SortMergeJoin") == 1


def test_ids_too_many_to_broadcast_filter_the_scan_of_the_mentions(spark, staged, no_auto_broadcast):
    """The id list reaches the mentions as a Bloom filter and a range, below the first exchange."""
    key = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"  # 10 GB
    spark.conf.set(key, "0")
    try:
        p = E.P2.with_(limit=None, minimum_distinct_source_count=3)
        ids = materialise(selection.distinct_event_ids(staged.mentions, p))
        low, high = ids.agg({"GLOBALEVENTID": "min"}).first()[0], ids.agg({"GLOBALEVENTID": "max"}).first()[0]
        within = f"GLOBALEVENTID between {low} and {high}"
        best = selection.best_events(selection.confident_mentions(staged.mentions, p).where(within), p, True, ids.where(within))
        text = plan(best)
        tree = text[:text.index("(1) ")]
        assert re.search(r"Exchange \(5\)\s+:\s+\+- HashAggregate \(4\)\s+:\s+\+- Project \(3\)\s+:\s+\+- Filter \(2\)\s+:\s+\+- Scan", tree)
        scan, kept = text[text.index("(1) Scan"):text.index("(2) Filter")], text[text.index("(2) Filter"):text.index("(3) ")]
        assert "might_contain" in kept and f"LessThanOrEqual(GLOBALEVENTID,{high})" in scan and "part_day" in scan
        got = rows_of_spark(best)
    finally:
        spark.conf.unset(key)
    plain = selection.best_events(selection.confident_mentions(staged.mentions, p).join(ids, "GLOBALEVENTID", "left_semi"), p, True)
    assert got == rows_of_spark(plain) and got[1]


def test_limit_has_no_window_or_merge_over_all_rows_in_one_task(spark, staged):
    p = E.P1.with_(minimum_distinct_source_count=3, limit=37)
    df = selection.select_flat(staged, p)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in text and "GlobalLimit" not in text and df.count() == 37
    alone = re.findall(r"windowspecdefinition\((?!_range)[^)]*\)", text)
    assert all(w.startswith("windowspecdefinition(_range") or "_range" in w for w in alone)
    assert not re.search(r"Window \[[^\]]*\], \[(eventSourceCount|rank)", text)
    for limit in (0, 1, 36, 37, 38, 10 ** 6):
        part = selection.select_flat(staged, p.with_(limit=limit))
        first = selection.select_flat(staged, p.with_(limit=None)).orderBy(*selection.flat_order()).limit(limit)
        assert rows_of_spark(part) == rows_of_spark(first), limit


def test_bucketed_tables_leave_the_mentions_in_place(spark, staged, no_auto_broadcast):
    tables = bucketed_tables(spark, fx1_tables(spark, SF001), 8)
    for p in (E.P1, E.P2):
        p = p.with_(limit=None, minimum_distinct_source_count=3)
        whole = selection.select_flat(tables, p)
        tree = whole._jdf.queryExecution().executedPlan().toString()
        assert tree_ops(tree, "Exchange") == 1           # the written per-event side
        mentions = tree[tree.index(":- "):tree.index("+- Sort [GLOBALEVENTID", tree.index(":- ") + 1)]
        assert "Exchange" not in mentions and "mentions_" in mentions and "PartitionFilters: [isnotnull(part_day" in tree
        assert rows_of_spark(whole) == rows_of_spark(selection.select_flat(staged, p)) and whole.count()
    folded = selection.best_events_folded(tables.mentions, E.P1)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in folded
    assert "Exchange" in selection.best_events_folded(staged.mentions, E.P1)._jdf.queryExecution().executedPlan().toString()


def test_bucketed_layout_known_to_another_catalog(spark, tmp_path):
    from outletlens.sources.tables import MENTIONS_SCHEMA, register_bucketed, write_bucketed

    mentions = fx1_tables(spark, SF001).mentions
    write_bucketed(mentions, "bucketed_once", str(tmp_path / "m"), 4)
    spark.sql("DROP TABLE bucketed_once")  # external: the files stay
    again = register_bucketed(spark, "bucketed_again", str(tmp_path / "m"), MENTIONS_SCHEMA, 4)
    assert rows_of_spark(again) == rows_of_spark(mentions)
    assert "Exchange" not in again.groupBy("GLOBALEVENTID").count()._jdf.queryExecution().executedPlan().toString()


def test_rows_of_a_task_do_not_grow_with_the_fx2_tables(spark, tmp_path, monkeypatch):
    spark.range(400).selectExpr("id AS o_orderkey", "timestamp'1996-01-01' + make_interval(0, 0, 0, cast(id AS int)) AS o_orderdate").write.parquet(
        f"{tmp_path}/orders.parquet")
    spark.range(2000).selectExpr("id % 410 AS l_orderkey", "id AS l_partkey", "id % 7 AS l_suppkey", "cast(id div 410 AS int) AS l_linenumber",
                                 "cast(id % 50 AS double) AS l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    few = rows_of_spark(selection.select_flat(fx2_tables(spark, str(tmp_path)), E.FX2))
    monkeypatch.setattr(keyed, "ROWS_A_TASK", 50)
    spread = fx2_tables(spark, str(tmp_path))
    tasks = spread.mentions.withColumn("task", F.spark_partition_id()).groupBy("task").count()
    assert tasks.agg(F.max("count")).first()[0] <= 3 * 50
    assert sorted(rows_of_spark(selection.select_flat(spread, E.FX2)), key=repr) == sorted(few, key=repr) and few


def test_keyed_lists_are_broadcast_by_size_only(spark, no_auto_broadcast):
    flat = prepare(materialise(E._flat(spark, SF001).selectExpr("'d' AS dataset", "*")), ("dataset",))
    tone = graph.outlet_tone(flat.mentions, flat.keys)
    kept = graph.filtered(tone, graph.top_sources(tone, flat.keys), flat.keys)
    dd = stacked.hour_dedup(flat.full, flat.keys)
    ranks = stacked.ranked_counts(dd, stacked.dom_outlets(dd, flat.keys), flat.keys)
    for df in (kept, ranks):
        assert "Broadcast" not in plan(df)
