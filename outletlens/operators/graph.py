"""Co-coverage graph of the leading outlets.

Nodes are full outlet domains; an undirected edge joins two outlets that
covered the same event, with the number of shared events and the mean tone
distance. Stages and their semantics:

1. ``outlet_tone``: per (event, outlet) the mean tone, rounded half-even to
   cents, and the first non-null URL (earliest ``mentionDateAdded``, then URL).
   Null outlets drop out (pandas groupby drops null keys).
2. ``top_sources``: the ``n`` outlets (default 40) covering the most events;
   ties by name.
3. ``filtered``: ``outlet_tone`` of those outlets (broadcast semi-join; the top
   list has at most n rows per dataset).
4. ``pairs``: self-join on the event with ``source1 < source2``, which yields
   exactly the canonical, de-duplicated pairs of the reference's cross product
   (swap + drop_duplicates), with url1/url2 of source1/source2. The top-n filter
   runs first, so an event contributes at most n(n-1)/2 pairs however many
   mentions it has: the join is never skewed.
5. ``edges``/``totals``/``nodes``/``edge_events``: aggregates, on integer cents.

Rounding is staged as in the reference: per-event tones are rounded first,
distances and node means are computed from the rounded values, then rounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outletlens.functions.exprs import cents_to_double, to_cents
from outletlens.functions.keyed import bounded_side, top_k
from outletlens.params import GRAPH_TOP_OUTLETS
from outletlens.session import materialise

SRC = "mentionSourceName"


def outlet_state(mentions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """What the graph keeps of mentions, per (keys, eventId, mentionSourceName): tone sum and count, and the
    earliest mention with a URL. States of parts of the mentions merge into that of the whole
    (``merge_outlet_states``)."""
    url = F.col("mentionIdentifier")
    return (mentions.where(F.col(SRC).isNotNull())
            .groupBy(*keys, "eventId", SRC)
            .agg(F.sum("mentionDocTone").alias("toneSum"), F.count("mentionDocTone").alias("toneCount"),
                 F.min(F.when(url.isNotNull(), F.struct("mentionDateAdded", "mentionIdentifier"))).alias("first")))


def merge_outlet_states(states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return states.groupBy(*keys, "eventId", SRC).agg(
        F.sum("toneSum").alias("toneSum"), F.sum("toneCount").alias("toneCount"), F.min("first").alias("first"))


def tone_of_state(state: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, eventId, mentionSourceName) -> avgToneCents, mentionIdentifier; null mean without a tone."""
    mean = F.when(F.col("toneCount") > 0, F.col("toneSum") / F.col("toneCount"))
    return state.select(*keys, "eventId", SRC, to_cents(mean).alias("avgToneCents"),
                        F.col("first.mentionIdentifier").alias("mentionIdentifier"))


def outlet_tone(mentions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, eventId, mentionSourceName) -> avgToneCents, mentionIdentifier.

    One aggregation computes both the mean and the first URL (the reference runs
    two groupbys and joins them on the same keys)."""
    return tone_of_state(outlet_state(mentions, keys), keys)


def top_sources(tone: DataFrame, keys: Sequence[str] = (), n: int = GRAPH_TOP_OUTLETS) -> DataFrame:
    """The ``n`` outlets with the most events (per key), ties by name ascending."""
    counts = tone.groupBy(*keys, SRC).agg(F.count(F.lit(1)).alias("mentionnedEventsCount"))
    return top_k(counts, keys, [F.col("mentionnedEventsCount").desc(), F.col(SRC).asc()], n,
                 rank_col="outlet_rank")


def filtered(tone: DataFrame, top: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``outlet_tone`` rows of the top outlets (broadcast left semi-join: the top
    list is bounded by n rows per key)."""
    return tone.join(bounded_side(top.select(*keys, SRC), keys), [*keys, SRC], "left_semi")


def pairs(filt: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Canonical outlet pairs per event (source1 < source2), tones in cents."""
    a = filt.select(*keys, "eventId", F.col(SRC).alias("source1"),
                    F.col("avgToneCents").alias("avgTone1Cents"),
                    F.col("mentionIdentifier").alias("url1"))
    b = filt.select(*keys, "eventId", F.col(SRC).alias("source2"),
                    F.col("avgToneCents").alias("avgTone2Cents"),
                    F.col("mentionIdentifier").alias("url2"))
    cond = [a[c] == b[c] for c in [*keys, "eventId"]] + [a["source1"] < b["source2"]]
    j = a.join(b, cond)
    return j.select(*[a[c] for c in keys], a["eventId"], "source1", "source2",
                    "avgTone1Cents", "avgTone2Cents", "url1", "url2")


def edge_events(pr: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Long form of the per-edge event map: one row per (edge, event)."""
    return pr.select(*keys, "source1", "source2", "eventId",
                     cents_to_double("avgTone1Cents").alias("avgTone1"),
                     cents_to_double("avgTone2Cents").alias("avgTone2"),
                     "url1", "url2")


def edges(pr: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per edge: rows (events) shared, and the rounded mean of the rounded tone
    distances (NULL distances counted, not averaged)."""
    dist = F.abs(F.col("avgTone1Cents") - F.col("avgTone2Cents"))
    return (pr.groupBy(*keys, "source1", "source2")
            .agg(F.count(F.lit(1)).alias("eventsSharedCount"),
                 cents_to_double(F.rint(F.avg(dist)).cast("long")).alias("meanToneDist")))


def totals(edg: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Maxima over the edges (one row; NULLs when there is no edge)."""
    return edg.groupBy(*keys).agg(F.max("meanToneDist").alias("maxToneDist"),
                                  F.max("eventsSharedCount").alias("maxSharedEventsCount"))


def nodes(filt: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per top outlet: events covered and the rounded mean of its rounded tones."""
    return (filt.groupBy(*keys, SRC)
            .agg(F.count(F.lit(1)).alias("mentionnedEventsCount"),
                 cents_to_double(F.rint(F.avg("avgToneCents")).cast("long")).alias("avgTone")))


def edges_nested(edg: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Document form of the edge aggregates: one row per source1 with
    ``targets: map<source2, struct<meanToneDist, eventsSharedCount>>``. A map has
    fewer than n entries (n = top outlets), so the collect is bounded. The
    per-edge event lists stay in ``edge_events`` (long form): their size grows
    with the data and they are never gathered into one value."""
    entry = F.struct(F.col("source2"),
                     F.struct("meanToneDist", "eventsSharedCount"))
    return (edg.groupBy(*keys, "source1")
            .agg(F.map_from_entries(F.collect_list(entry)).alias("targets")))


def nodes_nested(nds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``nodes: map<outlet, struct<mentionnedEventsCount, avgTone>>`` per key
    (at most n entries)."""
    entry = F.struct(F.col(SRC), F.struct("mentionnedEventsCount", "avgTone"))
    return nds.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("nodes"))


def graph(mentions: DataFrame, keys: Sequence[str] = (), n: int = GRAPH_TOP_OUTLETS) -> dict[str, DataFrame]:
    """All graph parts from the mentions of one (or, with keys, many) datasets.

    ``outlet_tone`` feeds the top list and the filter, and what the filter leaves (at most n
    rows an event) feeds every part: each is written once, in two jobs while the plan is
    built, so that no part scans the mentions again."""
    return graph_of_tone(materialise(outlet_tone(mentions, keys)), keys, n)


def graph_of_tone(tone: DataFrame, keys: Sequence[str] = (), n: int = GRAPH_TOP_OUTLETS) -> dict[str, DataFrame]:
    """The parts from ``outlet_tone``, which is read twice."""
    filt = materialise(filtered(tone, top_sources(tone, keys, n), keys))
    pr = pairs(filt, keys)
    edg = edges(pr, keys)
    nds = nodes(filt, keys)
    return {
        "edges": edg,
        "edge_events": edge_events(pr, keys),
        "nodes": nds,
        "totals": totals(edg, keys),
        "edges_nested": edges_nested(edg, keys),
        "nodes_nested": nodes_nested(nds, keys),
    }
