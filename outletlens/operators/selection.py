"""Event selection: widely reported events of a time window, one row per mention.

Semantics kept from the reference's query (read them before "simplifying"):

* The partition window is half-open on the raw end (``part_day`` midnight <
  end), the integer time ranges are closed.
* The regex and event-time filters choose *events*; afterwards every confident
  mention of those events returns, matching or not. The id search has no
  confidence filter.
* ``eventSourceCount``/``eventAvgTone`` come from all confident mentions in the
  partition window; the mention-time range is applied after that, so a flat
  row may show more sources than it has rows.
* The limit cuts mention rows in ``eventSourceCount`` order; ties are broken by
  ``eventId, mentionDateAdded, mentionSourceName, mentionIdentifier,
  mentionDocTone`` so results are deterministic.

Plan shape: every join and aggregate is keyed on ``GLOBALEVENTID``; partition
bounds are literals (static PartitionFilters); the id list reaches the events
side as a left semi-join (no distinct, no exchange of its own). Joins are left
to AQE: a side that turns out small at runtime is broadcast, otherwise a
sort-merge join whose hot partitions AQE splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outletlens.functions.keyed import running_total
from outletlens.params import Params
from outletlens.session import materialise
from outletlens.sources.fixtures import SourceTables
from outletlens.sources.tables import FLAT_COLUMNS, PART_COL

ID = "GLOBALEVENTID"


def flat_order() -> list[Column]:
    """Total order of the flat rows for the limit (reference: eventSourceCount
    DESC, ties unordered there)."""
    return [
        F.col("eventSourceCount").desc_nulls_last(),
        F.col("eventId").asc_nulls_last(),
        F.col("mentionDateAdded").asc_nulls_last(),
        F.col("mentionSourceName").asc_nulls_last(),
        F.col("mentionIdentifier").asc_nulls_last(),
        F.col("mentionDocTone").asc_nulls_last(),
    ]


def partition_window(p: Params) -> Column:
    """``begin_day <= part_day < end_day_exclusive``, both DATE literals."""
    return ((F.col(PART_COL) >= F.lit(p.begin_day)) &
            (F.col(PART_COL) < F.lit(p.end_day_exclusive)))


def event_ids(mentions: DataFrame, p: Params) -> DataFrame:
    """Ids of events with a mention in the window whose event time is in
    [begin, end] and, if a regex is given, whose URL matches it (partial match;
    Java regex dialect; the pattern is a bound literal, never spliced text)."""
    cond = partition_window(p) & F.col("EventTimeDate").between(p.begin_int, p.end_int)
    if p.filter_mention_id:
        cond = cond & F.col("MentionIdentifier").rlike(p.filter_mention_id)
    return mentions.where(cond).select(ID)


def distinct_event_ids(mentions: DataFrame, p: Params) -> DataFrame:
    """The distinct id list itself (the reference's first CTE)."""
    return event_ids(mentions, p).distinct()


def events_in_window(events: DataFrame, ids: DataFrame, p: Params) -> DataFrame:
    """Events of the window that are in ``ids`` (left semi-join)."""
    return (events.where(partition_window(p))
            .join(ids, ID, "left_semi")
            .select(ID, "DATEADDED", "Actor1Name", "Actor2Name", "GoldsteinScale"))


def confident_mentions(mentions: DataFrame, p: Params) -> DataFrame:
    """Mentions of the window with ``Confidence >= confidence``."""
    return (mentions.where(partition_window(p) & (F.col("Confidence") >= p.confidence))
            .select(ID, "MentionTimeDate", "MentionSourceName", "MentionIdentifier",
                    "MentionDocTone"))


def per_source_events(confident: DataFrame, p: Params) -> DataFrame:
    """Per (event, source): tone sum and count, and the mentions inside the mention-time range
    (``_rows_src``: their rows in the flat result). The map-side combine takes a hot event to
    one row per source and map task."""
    in_range = F.col("MentionTimeDate").between(p.begin_int, p.end_int)
    return (confident.groupBy(ID, "MentionSourceName")
            .agg(F.sum("MentionDocTone").alias("_tone_sum"), F.count("MentionDocTone").alias("_tone_n"),
                 F.count(F.when(in_range, F.lit(1))).alias("_rows_src")))


def best_events(confident: DataFrame, p: Params, with_rows: bool = False, ids: DataFrame | None = None) -> DataFrame:
    """Per event: distinct (non-null) sources and mean tone; keep events with at
    least ``minimum_distinct_source_count`` sources.

    Two grouping levels instead of COUNT(DISTINCT): (event, source) first, then the event; in
    between, ``ids`` (if given) restricts the events by a semi-join, whose side Spark broadcasts
    or not by its own threshold. ``with_rows`` also gives the event's rows in the flat result
    (``_rows``), from the same aggregation."""
    rows = per_source_events(confident, p)
    if ids is not None:
        rows = rows.join(ids, ID, "left_semi")
    extra = [F.sum("_rows_src").alias("_rows")] if with_rows else []
    return (rows.groupBy(ID)
            .agg(F.count("MentionSourceName").alias("distinctSourceCount"),
                 (F.sum("_tone_sum") / F.sum("_tone_n")).alias("avgDocTone"), *extra)
            .where(F.col("distinctSourceCount") >= p.minimum_distinct_source_count))


def best_events_folded(mentions: DataFrame, p: Params, with_rows: bool = False) -> DataFrame:
    """``best_events`` restricted to the events the id search would choose, from
    ONE aggregation over the window's mentions (no separate id scan/shuffle).

    The id search (event time in [begin, end], regex if any, no confidence
    filter) becomes a per-event flag; the source count, mean tone and row count
    use only confident mentions, through conditional aggregates. Same result as
    ``best_events(confident ⋉ event_ids)``."""
    conf = F.col("Confidence") >= p.confidence
    chosen = F.col("EventTimeDate").between(p.begin_int, p.end_int)
    if p.filter_mention_id:
        chosen = chosen & F.col("MentionIdentifier").rlike(p.filter_mention_id)
    in_range = F.col("MentionTimeDate").between(p.begin_int, p.end_int)
    tone = F.col("MentionDocTone")
    extra = [F.count(F.when(conf & in_range, F.lit(1))).alias("_rows_src")] if with_rows else []
    # rows below the confidence floor only feed the flag: they meet in one row an event
    source = F.when(conf, F.col("MentionSourceName")).alias("MentionSourceName")
    per_source = (mentions.where(partition_window(p))
                  .groupBy(ID, source)
                  .agg(F.sum(F.when(conf, tone)).alias("_tone_sum"),
                       F.count(F.when(conf, tone)).alias("_tone_n"),
                       F.max(conf).alias("_conf"),
                       F.max(chosen).alias("_chosen"), *extra))
    extra = [F.sum("_rows_src").alias("_rows")] if with_rows else []
    per_event = (per_source.groupBy(ID)
                 .agg(F.count("MentionSourceName").alias("distinctSourceCount"),
                      (F.sum("_tone_sum") / F.sum("_tone_n")).alias("avgDocTone"),
                      F.max("_conf").alias("_any_conf"),
                      F.max("_chosen").alias("_any_chosen"), *extra))
    return (per_event.where(F.col("_any_conf") & F.col("_any_chosen") &
                            (F.col("distinctSourceCount") >= p.minimum_distinct_source_count))
            .drop("_any_conf", "_any_chosen"))


def cut_at_limit(per_event: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None, int]:
    """Where the limit falls: the per-event rows whose mentions are all among the first ``limit`` flat
    rows, those of the event that the limit cuts (None if there is none), and how many of
    its mentions are left.

    Flat rows are ordered by ``eventSourceCount`` (= distinctSourceCount) and then by event, so
    whole events fill the limit in that order, up to the one that starts within it and ends
    beyond. Rows of one repeated event id stay together. The running sum over the events is a sum
    per range of the order plus a sum over the ranges (``running_total``), so the limit may be of
    any size; where all rows fit, their number is all that is computed."""
    per_event = per_event.where(F.col("_rows") > 0)
    if (per_event.agg(F.sum("_rows")).first()[0] or 0) <= limit:
        return per_event.drop("_rows"), None, 0
    rank = F.struct((-F.col("distinctSourceCount")).alias("c"), F.col(ID).alias("id"))
    events = per_event.groupBy(rank.alias("rank")).agg(F.sum("_rows").alias("_n"))
    starts = running_total(events, "_n", [F.col("rank")], "_before")
    cut = (starts.where(F.col("_before") <= limit).agg(F.max(F.struct("rank", "_before"))).first()[0])
    at = F.struct(F.lit(cut["rank"]["c"]).cast("long").alias("c"), F.lit(cut["rank"]["id"]).cast("long").alias("id"))
    per_event = per_event.drop("_rows")
    whole, last = per_event.where(rank < at), per_event.where(F.col(ID) == F.lit(cut["rank"]["id"]))
    left = limit - cut["_before"]
    return whole, last.where(rank == at) if left else None, left


def mentions_of_best(confident: DataFrame, best: DataFrame, p: Params) -> DataFrame:
    """Confident mentions of the best events with mention time in [begin, end]."""
    return (confident.where(F.col("MentionTimeDate").between(p.begin_int, p.end_int))
            .join(best, ID))


def project_flat(j: DataFrame) -> DataFrame:
    """Rename mention rows joined with event aggregates and attributes to the
    flat contract."""
    return j.select(
        F.col(ID).alias("eventId"),
        F.col("MentionTimeDate").alias("mentionDateAdded"),
        F.col("MentionSourceName").alias("mentionSourceName"),
        F.col("MentionIdentifier").alias("mentionIdentifier"),
        F.col("MentionDocTone").alias("mentionDocTone"),
        F.col("distinctSourceCount").alias("eventSourceCount"),
        F.col("avgDocTone").alias("eventAvgTone"),
        F.col("DATEADDED").alias("eventDateAdded"),
        F.col("Actor1Name").alias("eventActor1"),
        F.col("Actor2Name").alias("eventActor2"),
        F.col("GoldsteinScale").alias("eventGoldsteingScale"),
    )


def first_rows(flat: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows in ``flat_order()``, by their numbers in that order rather than by a merge
    of all partitions' first rows in one task."""
    numbered = running_total(flat.withColumn("_one", F.lit(1)), "_one", flat_order(), "_place")
    return numbered.where(F.col("_place") < n).select(*FLAT_COLUMNS)


def select_flat(tables: SourceTables, p: Params, strategy: str = "auto") -> DataFrame:
    """The whole selection: flat rows of the best events of the window.

    Two equivalent plans for the per-event aggregates:

    * ``"fold"``: the id search is a flag inside the per-event aggregation
      (``best_events_folded``): the window's mentions are scanned twice in all
      (aggregation, payload), with no id shuffle; the first shuffle carries
      map-side combined (event, source) rows, so a hot event is harmless.
    * ``"restrict"``: the id search runs first and its distinct ids are written once; they
      restrict the (event, source) rows and the events by left semi-joins. The written size
      lets Spark decide on a broadcast by its own threshold. The ids' range is a literal bound
      that reaches the scans, and where the ids are too many to broadcast, Spark's runtime filter
      puts a Bloom filter of them on the scan of the mentions, below the first exchange.

    ``"auto"`` takes ``restrict`` with a regex, which scans the URLs anyway and usually leaves few
    ids, and ``fold`` without one.

    The two one-row-per-event tables (aggregates, attributes) are joined first
    and written once as a table in the shared folder (a small job while the
    plan is built), so the mentions take part in a single join on the event id
    whose other side has a known size: Spark broadcasts it when it is under the
    broadcast threshold (the mentions are then never shuffled), otherwise it
    runs a sort-merge join whose hot partitions AQE splits. With a limit, the
    per-event table is first cut to the events that lie in the first ``limit`` rows as
    a whole (``cut_at_limit``); the one event that the limit splits is numbered by itself.
    """
    if strategy == "auto":
        strategy = "restrict" if p.filter_mention_id else "fold"
    if strategy not in ("fold", "restrict"):
        raise ValueError(f"unknown strategy {strategy!r}")
    confident = confident_mentions(tables.mentions, p)
    with_rows = p.limit is not None
    if strategy == "restrict":
        ids = materialise(distinct_event_ids(tables.mentions, p), how="table")
        low, high = ids.agg(F.min(ID), F.max(ID)).first()
        within = F.col(ID).between(F.lit(low).cast("long"), F.lit(high).cast("long"))
        ids, confident = ids.where(within), confident.where(within)
        events = events_in_window(tables.events.where(within), ids, p)
        best = best_events(confident, p, with_rows, ids)
    else:
        events = (tables.events.where(partition_window(p))
                  .select(ID, "DATEADDED", "Actor1Name", "Actor2Name", "GoldsteinScale"))
        best = best_events_folded(tables.mentions, p, with_rows)
    per_event = materialise(best.join(events, ID), how="table")
    in_range = confident.where(F.col("MentionTimeDate").between(p.begin_int, p.end_int))
    if p.limit is None:
        return project_flat(in_range.join(per_event, ID))
    whole, last, left = cut_at_limit(per_event, p.limit)
    flat = project_flat(in_range.join(whole, ID))
    if last is None:
        return flat
    rest = in_range.where(F.col(ID) == last.select(ID).first()[0])  # one event: a literal for the scan
    return flat.unionByName(first_rows(project_flat(rest.join(last, ID)), left))


def empty_guard(flat: DataFrame) -> DataFrame:
    """One row ``empty: boolean``: true when the selection has no row. Runs as a
    LIMIT 1 job over the plan, never a full count."""
    probe = flat.select(F.lit(1).alias("_one")).limit(1)
    return probe.agg((F.count(F.lit(1)) == 0).alias("empty"))
