"""Hourly series of how connected the leading outlets are.

Outlet identity here is the *short* name (text before the first dot), unlike
the graph. Stages:

1. ``hour_dedup``: mentions not later than the newest event, one row per
   (event, short outlet, hour) with the tone flag of the row kept
   (``mentionDocTone - eventAvgTone > 0`` of the earliest mention). Null outlets
   stay here (they count in ``dates``) and drop out of the grouped series.
2. ``num_other_sources``: per (hour, event[, tone class]) the non-null outlets
   minus one (a group of only null outlets gives -1, as in the reference).
3. ``outlet_degree``: per (hour, outlet) the sum of (2) over its events.
   ``outlet_degree_tone``: each mention meets every tone class of its
   (hour, event): agreeing = same class (n_same - 1), disagreeing = the other
   class, when that class exists, with the reference's -1 applied there too
   (``exact_disagreement=True`` gives n_other instead).
4. ``dom_outlets``: the 10 short outlets with the most events (ties by name),
   ranked 1..10.
5. ``streamgraph``: hours x top outlets, zero-filled, hours where at least one
   top outlet appears. ``drilldown``: (outlet, hour) with ``true``/``false``
   degrees, zero-filled, only pairs present.

(2)+(3) are computed with window counts over (hour, event) instead of a
group-by joined back: one exchange instead of two, and after the dedup a
partition holds at most one row per outlet, so a hot event cannot overload it.
The streamgraph and drill-down aggregate those per-mention counts directly
(one exchange each) instead of re-aggregating the long degree tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outletlens.functions.exprs import floor_time, positive_tone, short_outlet, space_z_label
from outletlens.functions.keyed import bounded_side, first_non_null, group_scalar_filter, top_k
from outletlens.params import STACKED_TIME_UNIT, STACKED_TOP_OUTLETS
from outletlens.session import materialise

SRC = "mentionSourceName"
HOUR = "roundedMentionDate"


def hour_dedup(full: DataFrame, keys: Sequence[str] = (), unit: str = STACKED_TIME_UNIT,
               short_name: bool = True) -> DataFrame:
    """(keys, eventId, short outlet, hour) -> positiveTone, over mentions with
    ``mentionDateAdded <= max(eventDateAdded)`` (per key)."""
    newest = full.groupBy(*keys).agg(F.max("eventDateAdded").alias("_max_date"))
    kept = group_scalar_filter(full, newest, keys,
                               lambda m: F.col("mentionDateAdded") <= m)
    src = short_outlet(SRC) if short_name else F.col(SRC)
    rows = kept.select(
        *keys, "eventId", src.alias(SRC),
        floor_time("mentionDateAdded", unit).alias(HOUR),
        positive_tone("mentionDocTone", "eventAvgTone").alias("positiveTone"),
        F.struct("mentionDateAdded", "mentionIdentifier", "mentionDocTone").alias("_order"))
    return (rows.groupBy(*keys, "eventId", SRC, HOUR)
            .agg(first_non_null("positiveTone", F.col("_order")).alias("positiveTone")))


def hour_state(full: DataFrame, keys: Sequence[str] = (), unit: str = STACKED_TIME_UNIT,
               short_name: bool = True) -> DataFrame:
    """What the series keep of mentions, per (keys, eventId, short outlet, hour): the earliest mention
    with its tone flag. Unlike ``hour_dedup`` nothing is left out for its date, as the newest
    event may still come; states of parts merge into that of the whole (``merge_hour_states``)."""
    src = short_outlet(SRC) if short_name else F.col(SRC)
    return (full.select(*keys, "eventId", src.alias(SRC), floor_time("mentionDateAdded", unit).alias(HOUR),
                        F.struct("mentionDateAdded", "mentionIdentifier", "mentionDocTone",
                                 positive_tone("mentionDocTone", "eventAvgTone").alias("positiveTone")).alias("first"))
            .groupBy(*keys, "eventId", SRC, HOUR).agg(F.min("first").alias("first")))


def merge_hour_states(states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return states.groupBy(*keys, "eventId", SRC, HOUR).agg(F.min("first").alias("first"))


def dedup_of_state(state: DataFrame, newest: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``hour_dedup`` from a state and the date of the newest event (per key): an hour's group is in
    it if its earliest mention is not later."""
    kept = group_scalar_filter(state, newest, keys, lambda m: F.col("first.mentionDateAdded") <= m)
    return kept.select(*keys, "eventId", SRC, HOUR, F.col("first.positiveTone").alias("positiveTone"))


def dates(dedup: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct hours (null outlets included) with their ``...Z`` label."""
    return (dedup.select(*keys, HOUR).distinct()
            .select(*keys, F.col(HOUR).alias("mentionInterval"),
                    space_z_label(HOUR).alias("label")))


def num_other_sources(dedup: DataFrame, keys: Sequence[str] = (),
                      with_tone: bool = False) -> DataFrame:
    """Per (hour, event[, positiveTone]): non-null outlets - 1."""
    g = [*keys, HOUR, "eventId"] + (["positiveTone"] if with_tone else [])
    return dedup.groupBy(*g).agg((F.count(SRC) - 1).alias("numOtherSources"))


def _event_hour_window(keys: Sequence[str]):
    return Window.partitionBy(*keys, HOUR, "eventId")


def co_outlet_counts(dedup: DataFrame, keys: Sequence[str] = (),
                     exact_disagreement: bool = False) -> DataFrame:
    """One row per de-duplicated mention with non-null outlet and its counts
    over its (hour, event), from a single window pass:

    * ``_all``: other outlets of the (hour, event) (non-null outlets - 1);
    * ``_same``: other outlets of its own tone class (n_same - 1);
    * ``_other``: the other tone class, n_other - 1 (n_other with
      ``exact_disagreement``), NULL when that class is absent from the
      (hour, event). A class present only through null outlets counts -1.
    """
    w = _event_hour_window(keys)
    pos = F.col("positiveTone")
    src = F.col(SRC)
    n_all = F.count(src).over(w)
    n_pos = F.count(F.when(pos, src)).over(w)            # non-null outlets per class
    n_neg = F.count(F.when(~pos, src)).over(w)
    r_pos = F.count(F.when(pos, F.lit(1))).over(w)       # class present at all
    r_neg = F.count(F.when(~pos, F.lit(1))).over(w)
    off = 0 if exact_disagreement else 1
    rows = dedup.select(*keys, HOUR, "eventId", SRC, pos.alias("_pos"),
                        n_all.alias("_na"), n_pos.alias("_np"), n_neg.alias("_nn"),
                        r_pos.alias("_rp"), r_neg.alias("_rn"))
    same = F.when(F.col("_pos"), F.col("_np")).otherwise(F.col("_nn")) - 1
    other = (F.when(F.col("_pos"), F.when(F.col("_rn") > 0, F.col("_nn") - off))
             .otherwise(F.when(F.col("_rp") > 0, F.col("_np") - off)))
    return (rows.where(F.col(SRC).isNotNull())
            .select(*keys, HOUR, "eventId", SRC, (F.col("_na") - 1).alias("_all"),
                    same.alias("_same"), other.alias("_other")))


def outlet_degree(dedup: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, hour, outlet) -> numOtherSources = sum over its events of the
    other outlets of the same (hour, event)."""
    return (co_outlet_counts(dedup, keys)
            .groupBy(*keys, HOUR, SRC)
            .agg(F.sum("_all").alias("numOtherSources")))


def outlet_degree_tone(dedup: DataFrame, keys: Sequence[str] = (),
                       exact_disagreement: bool = False) -> DataFrame:
    """(keys, hour, outlet, agreeing) -> numOtherSources. The ``false`` row of an
    (hour, outlet) exists only if some event had the other tone class."""
    rows = co_outlet_counts(dedup, keys, exact_disagreement)
    pairs = F.array(F.struct(F.lit(True).alias("agreeing"), F.col("_same").alias("_n")),
                    F.struct(F.lit(False).alias("agreeing"), F.col("_other").alias("_n")))
    exploded = (rows.select(*keys, HOUR, SRC, F.inline(pairs))
                .where(F.col("_n").isNotNull()))
    return (exploded.groupBy(*keys, HOUR, SRC, "agreeing")
            .agg(F.sum("_n").alias("numOtherSources")))


def dom_outlets(dedup: DataFrame, keys: Sequence[str] = (),
                n: int = STACKED_TOP_OUTLETS) -> DataFrame:
    """Top ``n`` short outlets by number of events, ranked (``outlet_rank``)."""
    per_event = dedup.where(F.col(SRC).isNotNull()).select(*keys, "eventId", SRC).distinct()
    counts = per_event.groupBy(*keys, SRC).agg(F.count(F.lit(1)).alias("eventsCount"))
    return top_k(counts, keys, [F.col("eventsCount").desc(), F.col(SRC).asc()], n,
                 rank_col="outlet_rank")


def ranked_counts(dedup: DataFrame, dom: DataFrame, keys: Sequence[str] = (),
                  exact_disagreement: bool = False) -> DataFrame:
    """``co_outlet_counts`` of the top outlets, with their rank (broadcast join: at most n
    rows per key)."""
    return co_outlet_counts(dedup, keys, exact_disagreement).join(
        bounded_side(dom.select(*keys, SRC, "outlet_rank"), keys), [*keys, SRC])


def streamgraph_wide(dedup: DataFrame, dom: DataFrame, keys: Sequence[str] = (),
                     n: int = STACKED_TOP_OUTLETS, ranked: DataFrame | None = None) -> DataFrame:
    """One row per hour with at least one top outlet, columns
    ``outlet_1..outlet_n`` (rank order; names in ``dom``), zero-filled.

    Straight from the per-mention counts: broadcast join with the top list (at
    most n rows per key), then one aggregation by hour with one conditional sum
    per rank (a static pivot: no job to find values, one exchange)."""
    ranked = ranked_counts(dedup, dom, keys) if ranked is None else ranked
    cols = [F.coalesce(F.sum(F.when(F.col("outlet_rank") == i, F.col("_all"))),
                       F.lit(0).cast("long")).alias(f"outlet_{i}") for i in range(1, n + 1)]
    return ranked.groupBy(*keys, F.col(HOUR).alias("mentionInterval")).agg(*cols)


def streamgraph_long(dedup: DataFrame, dom: DataFrame, keys: Sequence[str] = (),
                     n: int = STACKED_TOP_OUTLETS, ranked: DataFrame | None = None) -> DataFrame:
    """(keys, mentionInterval, outlet, numOtherSources): the wide table unpivoted,
    so every (hour, top outlet) cell exists (zero-filled) without a cross join."""
    wide = streamgraph_wide(dedup, dom, keys, n, ranked)
    long = wide.unpivot([*keys, "mentionInterval"], [f"outlet_{i}" for i in range(1, n + 1)],
                        "_slot", "numOtherSources")
    long = long.withColumn("outlet_rank", F.substring_index("_slot", "_", -1).cast("int"))
    return (long.join(bounded_side(dom.select(*keys, "outlet_rank", SRC), keys), [*keys, "outlet_rank"])
            .select(*keys, "mentionInterval", SRC, "numOtherSources"))


def streamgraph_nested(long: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Document form: per hour ``outlets: map<outlet name, numOtherSources>`` (at most n
    entries), the names being those of the top outlets."""
    entry = F.struct(F.col(SRC), F.col("numOtherSources"))
    return long.groupBy(*keys, "mentionInterval").agg(F.map_from_entries(F.collect_list(entry)).alias("outlets"))


def drilldown(dedup: DataFrame, dom: DataFrame, keys: Sequence[str] = (),
              exact_disagreement: bool = False, ranked: DataFrame | None = None) -> DataFrame:
    """(keys, outlet, mentionInterval) -> ``true``/``false`` degrees of the top
    outlets, zero-filled, always both columns; one aggregation over the
    per-mention counts (``false`` sums only events where the other class
    exists)."""
    rows = ranked_counts(dedup, dom, keys, exact_disagreement) if ranked is None else ranked
    zero = F.lit(0).cast("long")
    return (rows.groupBy(*keys, SRC, F.col(HOUR).alias("mentionInterval"))
            .agg(F.coalesce(F.sum("_same"), zero).alias("true"),
                 F.coalesce(F.sum("_other"), zero).alias("false")))


def drilldown_nested(dd: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per outlet the list of its hourly records sorted by hour. A list has at
    most one entry per hour of the window, so the collect is bounded by the
    window length, not by the data."""
    rec = F.struct("mentionInterval", "true", "false")
    return dd.groupBy(*keys, SRC).agg(F.sort_array(F.collect_list(rec)).alias("records"))


def stacked(full: DataFrame, keys: Sequence[str] = (), unit: str = STACKED_TIME_UNIT,
            n: int = STACKED_TOP_OUTLETS, short_name: bool = True,
            exact_disagreement: bool = False) -> dict[str, DataFrame]:
    """All stacked-series parts. The deduplicated mentions, the top list and the counts of the
    top outlets are each written once while the plan is built; every part aggregates one of
    these."""
    return stacked_of_dedup(materialise(hour_dedup(full, keys, unit, short_name)), keys, n, exact_disagreement)


def stacked_of_dedup(dedup: DataFrame, keys: Sequence[str] = (), n: int = STACKED_TOP_OUTLETS,
                     exact_disagreement: bool = False) -> dict[str, DataFrame]:
    """The parts from ``hour_dedup``, which is read several times."""
    dom = materialise(dom_outlets(dedup, keys, n))
    ranked = materialise(ranked_counts(dedup, dom, keys, exact_disagreement))
    dd = drilldown(dedup, dom, keys, exact_disagreement, ranked)
    long = streamgraph_long(dedup, dom, keys, n, ranked)
    return {
        "dates": dates(dedup, keys),
        "dom_outlets": dom,
        "streamgraph": long,
        "streamgraph_wide": streamgraph_wide(dedup, dom, keys, n, ranked),
        "streamgraph_nested": streamgraph_nested(long, keys),
        "drilldown": dd,
        "drilldown_nested": drilldown_nested(dd, keys),
    }
