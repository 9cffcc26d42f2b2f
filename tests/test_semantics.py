"""Operator semantics on hand-made frames; expected values computed by hand."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frames import flat, source_tables
from outletlens.functions.exprs import short_outlet, to_cents
from outletlens.operators import graph, selection, stacked
from outletlens.operators.prepare import prepare
from outletlens.params import Params
from outletlens.sources.tables import FLAT_SCHEMA


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# --- functions ---------------------------------------------------------------------

def test_cents_round_half_even_like_numpy(spark):
    values = [0.125, -0.125, 1.005, 2.675, 0.135, -43.5, 12.3456, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(to_cents("x")).collect()]
    want = [int(np.rint(v * 100)) for v in values]
    assert got == want
    assert got[:2] == [12, -12]


def test_short_outlet(spark):
    df = spark.createDataFrame([("www.a.com",), ("localhost",), (None,), ("",)], "s string")
    assert [r[0] for r in df.select(short_outlet("s")).collect()] == ["www", "localhost", None, ""]


def test_params_partition_bounds():
    p = Params("2024-01-05T06:00:00.000Z", "2024-01-12T00:00:00.000Z")
    assert p.begin_day == dt.date(2024, 1, 5)
    assert p.end_day_exclusive == dt.date(2024, 1, 12)      # midnight end: its day is not read
    assert p.with_(date_end="2024-01-12T00:00:01.000Z").end_day_exclusive == dt.date(2024, 1, 13)
    assert (p.begin_int, p.end_int) == (20240105060000, 20240112000000)
    with pytest.raises(ValueError):
        Params("2024-01-05T06:00:00Z")                       # fraction required
    assert p.query_id() != p.with_(filter_mention_id='a/"b').query_id()
    assert len(p.with_(filter_mention_id='a/"b').query_id()) == 64


# --- selection -----------------------------------------------------------------------

def _sel_tables(spark):
    d5, d6, d7 = dt.date(2024, 1, 5), dt.date(2024, 1, 6), dt.date(2024, 1, 7)
    m = [
        # event 1: 3 confident sources; one mention outside the mention-time range
        (1, 20240105000000, 20240105100000, "a.com", "http://a/x", 1.0, 100, d5),
        (1, 20240105000000, 20240105110000, "b.com", "http://b/y", 2.0, 100, d5),
        (1, 20240105000000, 20240106230000, "c.com", "http://c/click", 3.0, 100, d6),
        (1, 20240105000000, 20240105120000, "d.com", "http://d/z", 9.0, 10, d5),   # not confident
        # event 2: only 2 sources
        (2, 20240105000000, 20240105100000, "a.com", "http://a/q", 0.0, 100, d5),
        (2, 20240105000000, 20240105100000, "b.com", "http://b/q", 0.0, 100, d5),
        # event 3: its day's partition is excluded (end at midnight of day 7)
        (3, 20240107000000, 20240107000000, "a.com", "http://a/c", 0.0, 100, d7),
        (3, 20240107000000, 20240107000000, "b.com", "http://b/c", 0.0, 100, d7),
        (3, 20240107000000, 20240107000000, "c.com", "http://c/c", 0.0, 100, d7),
    ]
    e = [(1, 20240105180000, "A", None, 1.0, d5), (2, 20240105180000, "B", "C", 2.0, d5),
         (3, 20240107180000, "D", None, 3.0, d7)]
    return source_tables(spark, m, e)


def test_selection_two_populations_and_midnight_end(spark):
    t = _sel_tables(spark)
    p = Params("2024-01-05T00:00:00.000Z", "2024-01-07T00:00:00.000Z", 3, 100, 100000,
               "")
    p = p.with_(date_end="2024-01-06T12:00:00.000Z")
    out = selection.select_flat(t, p)
    # event 1 counts 3 sources (c.com's mention is after the end) but returns 2 rows
    assert rows(out, "eventId", "mentionSourceName", "eventSourceCount", "eventAvgTone") == [
        (1, "a.com", 3, 2.0), (1, "b.com", 3, 2.0)]
    p_mid = p.with_(date_end="2024-01-07T00:00:00.000Z")
    assert selection.select_flat(t, p_mid).where("eventId = 3").count() == 0


def test_selection_regex_selects_events_not_rows(spark):
    t = _sel_tables(spark)
    p = Params("2024-01-05T00:00:00.000Z", "2024-01-06T23:59:00.000Z", 3, 100, 100000, "click")
    out = selection.select_flat(t, p)
    # the regex matches only c.com's URL; every confident mention of event 1 returns
    assert rows(out, "mentionSourceName") == [("a.com",), ("b.com",), ("c.com",)]


def test_selection_regex_with_double_quote_is_a_literal(spark):
    t = _sel_tables(spark)
    p = Params("2024-01-05T00:00:00.000Z", "2024-01-06T23:59:00.000Z", 1, 100, 100000, 'x"y')
    assert selection.select_flat(t, p).count() == 0


def test_limit_cuts_rows_in_total_order(spark):
    t = _sel_tables(spark)
    p = Params("2024-01-05T00:00:00.000Z", "2024-01-06T23:59:00.000Z", 2, 100, 3, "")
    out = selection.select_flat(t, p)
    # event 1 (3 sources) first, then event 2 by (date, source)
    assert rows(out, "eventId", "mentionSourceName") == [(1, "a.com"), (1, "b.com"), (1, "c.com")]
    out2 = selection.select_flat(t, p.with_(limit=4))
    assert rows(out2, "eventId", "mentionSourceName")[-1] == (2, "a.com")


def test_empty_guard(spark):
    t = _sel_tables(spark)
    assert selection.empty_guard(selection.select_flat(t, Params())).first()["empty"] is True


# --- preparation ----------------------------------------------------------------------

def test_prepare_routes_extra_event_column(spark):
    schema = T.StructType(FLAT_SCHEMA.fields + [T.StructField("eventFoo", T.StringType())])
    df = flat(spark, [dict(eventId=1, eventFoo=None, mentionDateAdded=20240105100000),
                      dict(eventId=1, eventFoo="late", mentionDateAdded=20240105120000),
                      dict(eventId=1, eventFoo="early", mentionDateAdded=20240105110000)], schema)
    pr = prepare(df)
    assert "eventFoo" in pr.events.columns and "eventFoo" not in pr.mentions.columns
    assert pr.events.first()["eventFoo"] == "early"        # first non-null by time
    assert pr.mentions.columns == ["eventId", "mentionDateAdded", "mentionSourceName",
                                   "mentionIdentifier", "mentionDocTone"]
    assert pr.full.schema["mentionDateAdded"].dataType == T.TimestampNTZType()


# --- graph ----------------------------------------------------------------------------

def _graph_flat(spark):
    return flat(spark, [
        dict(eventId=1, mentionSourceName="a.com", mentionDocTone=1.0, mentionIdentifier=None),
        dict(eventId=1, mentionSourceName="a.com", mentionDocTone=2.0, mentionIdentifier="u-a2",
             mentionDateAdded=20240105110000),
        dict(eventId=1, mentionSourceName="a.com", mentionDocTone=float("nan"),
             mentionIdentifier="u-a1", mentionDateAdded=20240105120000),
        dict(eventId=1, mentionSourceName="b.com", mentionDocTone=-0.125, mentionIdentifier="u-b"),
        dict(eventId=1, mentionSourceName="c.com", mentionDocTone=0.125),
        dict(eventId=1, mentionSourceName=None, mentionDocTone=5.0),
        dict(eventId=2, mentionSourceName="a.com", mentionDocTone=0.0),
        dict(eventId=2, mentionSourceName="b.com", mentionDocTone=1.0),
    ])


def test_graph_parts(spark):
    g = graph.graph(prepare(_graph_flat(spark)).mentions)
    assert rows(g["edges"], "source1", "source2", "eventsSharedCount", "meanToneDist") == [
        ("a.com", "b.com", 2, 1.31), ("a.com", "c.com", 1, 1.38), ("b.com", "c.com", 1, 0.24)]
    assert rows(g["nodes"], "mentionSourceName", "mentionnedEventsCount", "avgTone") == [
        ("a.com", 2, 0.75), ("b.com", 2, 0.44), ("c.com", 1, 0.12)]
    assert rows(g["totals"], "maxToneDist", "maxSharedEventsCount") == [(1.38, 2)]
    ev = rows(g["edge_events"], "source1", "source2", "eventId", "avgTone1", "avgTone2", "url1", "url2")
    assert ev[0] == ("a.com", "b.com", 1, 1.5, -0.12, "u-a2", "u-b")   # earliest non-null URL
    assert ("a.com", "c.com", 1, 1.5, 0.12, "u-a2", None) in ev          # all-null URL stays null
    nested = g["edges_nested"].where("source1 = 'a.com'").first()["targets"]
    assert nested["b.com"]["eventsSharedCount"] == 2


def test_graph_rounding_ties_are_half_even(spark):
    df = flat(spark, [dict(eventId=1, mentionSourceName="a.com", mentionDocTone=0.01),
                      dict(eventId=2, mentionSourceName="a.com", mentionDocTone=0.02),
                      dict(eventId=1, mentionSourceName="b.com", mentionDocTone=0.03),
                      dict(eventId=2, mentionSourceName="b.com", mentionDocTone=0.02)])
    g = graph.graph(prepare(df).mentions)
    # node means 1.5 and 2.5 cents both round to 2; edge distances 2 and 0 -> 1
    assert rows(g["nodes"], "mentionSourceName", "avgTone") == [("a.com", 0.02), ("b.com", 0.02)]
    assert rows(g["edges"], "meanToneDist") == [(0.01,)]


def test_graph_top_ties_by_name_and_single_outlet(spark):
    df = flat(spark, [dict(eventId=1, mentionSourceName="c.com"),
                      dict(eventId=2, mentionSourceName="b.com"),
                      dict(eventId=3, mentionSourceName="a.com")])
    g = graph.graph(prepare(df).mentions, n=2)
    assert rows(g["nodes"], "mentionSourceName") == [("a.com",), ("b.com",)]
    assert g["edges"].count() == 0
    assert rows(g["totals"], "maxToneDist", "maxSharedEventsCount") == [(None, None)]


# --- stacked --------------------------------------------------------------------------

def _stacked_flat(spark):
    h = 20240105100000
    return flat(spark, [
        # event 1, one hour: x, y positive, z negative (eventAvgTone 0)
        dict(eventId=1, mentionSourceName="x.com", mentionDocTone=1.0, mentionDateAdded=h),
        dict(eventId=1, mentionSourceName="x.org", mentionDocTone=1.0, mentionDateAdded=h + 500),
        dict(eventId=1, mentionSourceName="y.com", mentionDocTone=1.0, mentionDateAdded=h),
        dict(eventId=1, mentionSourceName="z.com", mentionDocTone=-1.0, mentionDateAdded=h),
        dict(eventId=1, mentionSourceName=None, mentionDocTone=-1.0, mentionDateAdded=h + 10000),
        # event 2, same hour: x alone
        dict(eventId=2, mentionSourceName="x.net", mentionDocTone=1.0, mentionDateAdded=h + 100),
        # after the newest event date: dropped
        dict(eventId=2, mentionSourceName="w.com", mentionDocTone=1.0,
             mentionDateAdded=20240107000000),
    ])


def test_stacked_parts(spark):
    s = stacked.stacked(prepare(_stacked_flat(spark)).full)
    assert rows(s["dates"], "label") == [("2024-01-05 10:00:00Z",), ("2024-01-05 11:00:00Z",)]
    assert rows(s["dom_outlets"], "mentionSourceName", "eventsCount", "outlet_rank") == [
        ("x", 2, 1), ("y", 1, 2), ("z", 1, 3)]
    assert rows(s["streamgraph"], "mentionSourceName", "numOtherSources") == [
        ("x", 2), ("y", 2), ("z", 2)]
    assert rows(s["drilldown"], "mentionSourceName", "true", "false") == [
        ("x", 1, 0), ("y", 1, 0), ("z", 0, 1)]
    wide = s["streamgraph_wide"].first()
    assert (wide["outlet_1"], wide["outlet_2"], wide["outlet_3"], wide["outlet_4"]) == (2, 2, 2, 0)
    rec = s["drilldown_nested"].where("mentionSourceName = 'z'").first()["records"]
    assert [(r["true"], r["false"]) for r in rec] == [(0, 1)]


def test_stacked_exact_disagreement_option(spark):
    dd = stacked.hour_dedup(prepare(_stacked_flat(spark)).full)
    quirk = stacked.outlet_degree_tone(dd)
    exact = stacked.outlet_degree_tone(dd, exact_disagreement=True)
    assert rows(quirk.where("NOT agreeing"), "mentionSourceName", "numOtherSources") == [
        ("x", 0), ("y", 0), ("z", 1)]
    assert rows(exact.where("NOT agreeing"), "mentionSourceName", "numOtherSources") == [
        ("x", 1), ("y", 1), ("z", 2)]


def test_stacked_null_only_class_counts_minus_one(spark):
    # event 1 at 11h: only a null outlet is negative -> x meets a group of -1
    h = 20240105110000
    df = flat(spark, [dict(eventId=1, mentionSourceName="x.com", mentionDocTone=1.0, mentionDateAdded=h),
                      dict(eventId=1, mentionSourceName=None, mentionDocTone=-1.0, mentionDateAdded=h)])
    dd = stacked.hour_dedup(prepare(df).full)
    assert rows(stacked.outlet_degree_tone(dd), "agreeing", "numOtherSources") == [
        (False, -1), (True, 0)]
    assert rows(stacked.num_other_sources(dd, with_tone=True), "positiveTone", "numOtherSources") == [
        (False, -1), (True, 0)]


def test_stacked_kept_row_decides_tone(spark):
    # same (event, outlet, hour) twice: the earliest mention's flag is kept
    df = flat(spark, [dict(eventId=1, mentionSourceName="x.com", mentionDocTone=-1.0,
                           mentionDateAdded=20240105100500),
                      dict(eventId=1, mentionSourceName="x.com", mentionDocTone=1.0,
                           mentionDateAdded=20240105100100)])
    dd = stacked.hour_dedup(prepare(df).full)
    assert rows(dd, "mentionSourceName", "positiveTone") == [("x", True)]


def test_stacked_every_mention_positive_gives_zero_false(spark):
    df = flat(spark, [dict(eventId=1, mentionSourceName="x.com", mentionDocTone=1.0),
                      dict(eventId=1, mentionSourceName="y.com", mentionDocTone=1.0)])
    s = stacked.stacked(prepare(df).full)
    assert rows(s["drilldown"], "mentionSourceName", "true", "false") == [("x", 1, 0), ("y", 1, 0)]


@pytest.mark.parametrize("params", [
    Params("2024-01-05T00:00:00.000Z", "2024-01-06T12:00:00.000Z", 3, 100, 100000, ""),
    Params("2024-01-05T00:00:00.000Z", "2024-01-06T23:59:00.000Z", 3, 100, 100000, "click"),
    Params("2024-01-05T00:00:00.000Z", "2024-01-06T23:59:00.000Z", 2, 100, 4, ""),
    Params("2024-01-05T00:00:00.000Z", "2024-01-06T23:59:00.000Z", 0, 100, None, ""),
])
def test_selection_strategies_agree(spark, params):
    t = _sel_tables(spark)
    cols = ["eventId", "mentionSourceName", "mentionDateAdded", "eventSourceCount", "eventAvgTone"]
    fold = rows(selection.select_flat(t, params, strategy="fold"), *cols)
    restrict = rows(selection.select_flat(t, params, strategy="restrict"), *cols)
    assert fold == restrict


def test_restrict_plan_holds_no_broadcast_hint(spark):
    t = _sel_tables(spark)
    p = Params("2024-01-05T00:00:00.000Z", "2024-01-06T23:59:00.000Z", 3, 100, 100000, "click")
    cols = ["eventId", "mentionSourceName", "eventSourceCount"]
    want = rows(selection.select_flat(t, p), *cols)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = selection.select_flat(t, p)
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
        assert rows(df, *cols) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_limit_cut_keeps_whole_events_up_to_the_limit(spark):
    per_event = spark.createDataFrame([(i, 7 if i < 50 else 3, 0.0, 2) for i in range(200)],
                                      "GLOBALEVENTID long, distinctSourceCount long, avgDocTone double, _rows long")
    ids = lambda df: sorted(r[0] for r in df.select("GLOBALEVENTID").collect())
    whole, last, left = selection.cut_at_limit(per_event, 11)
    assert (ids(whole), ids(last), left) == ([0, 1, 2, 3, 4], [5], 1)
    whole, last, left = selection.cut_at_limit(per_event, 104)  # over to the next source count
    assert (ids(whole), last, left) == (list(range(52)), None, 0)
    whole, last, left = selection.cut_at_limit(per_event, 400)
    assert (ids(whole), last, left) == (list(range(200)), None, 0)
    whole, last, left = selection.cut_at_limit(per_event, 0)
    assert (ids(whole), last, left) == ([], None, 0)


def test_running_total_over_ranges(spark):
    from outletlens.functions.keyed import running_total

    rows = [(i % 50, i) for i in range(300)]
    got = running_total(spark.createDataFrame(rows, "k long, n long"), "n", [F.col("k"), F.col("n")], "before").collect()
    total = 0
    for r in sorted(got, key=lambda r: (r.k, r.n)):
        assert r.before == total
        total += r.n


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_a_malformed_date_raises_whatever_the_session(spark, ansi):
    from outletlens.functions.exprs import int_date_to_ts

    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        at = lambda *v: [r[0] for r in spark.createDataFrame([(x,) for x in v], "d long").select(int_date_to_ts("d").cast("string")).collect()]
        assert at(20240229235959, None, 19990101000000) == ["2024-02-29 23:59:59", None, "1999-01-01 00:00:00"]
        for bad in (20230229000000, 20241301000000, 20240101240000, 20240101006000, 20240101000060, 20240101, 0, -20240101000000, 120240101000000):
            with pytest.raises(Exception, match="not a date of the form"):
                at(20240101000000, bad)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_graph_and_stacked_parts_read_written_tables(spark):
    flat = prepare(_graph_flat(spark))
    for parts in (graph.graph(flat.mentions), stacked.stacked(flat.full)):
        for name, df in parts.items():
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            assert "parquet" in plan and "LogicalRDD" not in plan and "LocalRelation" not in plan, name
