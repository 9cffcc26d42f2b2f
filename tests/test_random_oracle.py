"""Random flat frames (nulls, duplicates, ties, shared short names) through the
Spark analyses and through the DuckDB oracle CTEs."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from compare import compare
from outletlens import oracle as O
from outletlens.operators import graph, stacked
from outletlens.operators.prepare import prepare
from outletlens.sources.tables import FLAT_SCHEMA

SOURCES = ["a.com", "b.com", "www.a.com", "www.b.com", "c.org", "localhost", None]
URLS = ["u1", "u2", "u3", None]


def random_flat(seed: int, n: int = 60) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    events = np.arange(1, 7)
    ev_avg = {e: rng.integers(-8, 8) / 4 for e in events}
    ev_hour = {e: divmod(int(rng.integers(10, 34)), 24) for e in events}
    ev_date = {e: 20240105000000 + d * 1000000 + h * 10000 for e, (d, h) in ev_hour.items()}
    rows = []
    for _ in range(n):
        e = int(rng.choice(events))
        hour = int(rng.integers(0, 36))
        day, hh = divmod(hour, 24)
        minute = int(rng.choice([0, 15, 30]))
        tone = None if rng.random() < 0.1 else float(rng.integers(-12, 12) / 4)
        rows.append(dict(eventId=e, mentionDateAdded=20240105000000 + day * 1000000 + hh * 10000 + minute * 100,
                         mentionSourceName=SOURCES[int(rng.integers(0, len(SOURCES)))],
                         mentionIdentifier=URLS[int(rng.integers(0, len(URLS)))],
                         mentionDocTone=tone, eventSourceCount=3, eventAvgTone=ev_avg[e],
                         eventDateAdded=ev_date[e], eventActor1="x", eventActor2=None,
                         eventGoldsteingScale=1.0))
    return pd.DataFrame(rows, columns=FLAT_SCHEMA.fieldNames())


def oracle(pdf: pd.DataFrame, body: str) -> tuple:
    con = duckdb.connect()
    con.register("rnd", pdf)
    con.execute("CREATE TABLE flat AS SELECT eventId::BIGINT AS eventId, mentionDateAdded::BIGINT AS "
                "mentionDateAdded, mentionSourceName::VARCHAR AS mentionSourceName, mentionIdentifier::VARCHAR "
                "AS mentionIdentifier, mentionDocTone::DOUBLE AS mentionDocTone, eventSourceCount::BIGINT AS "
                "eventSourceCount, eventAvgTone::DOUBLE AS eventAvgTone, eventDateAdded::BIGINT AS "
                "eventDateAdded, eventActor1::VARCHAR AS eventActor1, eventActor2::VARCHAR AS eventActor2, "
                "eventGoldsteingScale::DOUBLE AS eventGoldsteingScale FROM rnd")
    sql = "WITH " + (O.PREP_CTES + O.GRAPH_CTES + O.STACKED_CTES).lstrip(",\n") + "\n" + body
    return con, sql


CASES = {
    "edges": (lambda g, s: g["edges"], "SELECT * FROM edges"),
    "nodes": (lambda g, s: g["nodes"],
              "SELECT mentionSourceName, count(*) AS mentionnedEventsCount, "
              "CAST(CAST(round_even(avg(cents), 0) AS BIGINT) AS DOUBLE) / 100 AS avgTone "
              "FROM filt GROUP BY mentionSourceName"),
    "edge_events": (lambda g, s: g["edge_events"],
                    "SELECT source1, source2, eventId, CAST(avgTone1Cents AS DOUBLE) / 100 AS avgTone1, "
                    "CAST(avgTone2Cents AS DOUBLE) / 100 AS avgTone2, url1, url2 FROM pairs"),
    "drilldown": (lambda g, s: s["drilldown"],
                  'SELECT mentionSourceName, mentionInterval, "true", "false" FROM dd'),
    "streamgraph": (lambda g, s: s["streamgraph"],
                    "SELECT mentionInterval, mentionSourceName, numOtherSources FROM sg_long"),
    "dates": (lambda g, s: s["dates"],
              "SELECT DISTINCT roundedMentionDate AS mentionInterval, "
              "strftime(roundedMentionDate, '%Y-%m-%d %H:%M:%SZ') AS label FROM dedup"),
    "dom": (lambda g, s: s["dom_outlets"], "SELECT * FROM dom"),
}


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_random_frames_match_oracle(spark, seed):
    pdf = random_flat(seed)
    sdf = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), FLAT_SCHEMA)
    pr = prepare(sdf)
    g, s = graph.graph(pr.mentions), stacked.stacked(pr.full)
    for name, (pick, body) in CASES.items():
        con, sql = oracle(pdf, body)
        ok, msg = compare(pick(g, s), con, sql)
        assert ok, f"seed {seed} {name}: {msg}"
    # the degree with tone classes, the part with the -1 quirk
    con, sql = oracle(pdf, "SELECT * FROM degree_tone")
    ok, msg = compare(stacked.outlet_degree_tone(stacked.hour_dedup(pr.full)), con, sql)
    assert ok, f"seed {seed} degree_tone: {msg}"
