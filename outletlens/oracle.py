"""Oracle SQL (DuckDB dialect) for every registered query.

Written from the semantics, not from the Spark code: the selection follows the
reference's CTE chain literally (COUNT(DISTINCT), IN-subquery, ORDER BY+LIMIT),
the stacked series use a group-by joined back (the reference's merge) where the
Spark side uses window counts, and the streamgraph grid is a cross join here
where Spark unpivots. Tables ``events``, ``orders``, ``lineitem`` are the
driver's pre-registered views.
"""

from __future__ import annotations

from outletlens.params import Params

# --- fixture CTEs -------------------------------------------------------------------

FX1_MENTIONS = """
  SELECT
    CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 10
         + CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2
                           WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS BIGINT) AS GLOBALEVENTID,
    CAST(strftime(CAST(ts AS DATE), '%Y%m%d') AS BIGINT) * 1000000 AS EventTimeDate,
    CAST(strftime(ts, '%Y%m%d%H%M%S') AS BIGINT) AS MentionTimeDate,
    'site' || CAST(user_id % 60 AS VARCHAR) || '.example.com' AS MentionSourceName,
    'http://site' || CAST(user_id % 60 AS VARCHAR) || '.example.com/' || event_type || '/'
      || CAST(event_id AS VARCHAR) AS MentionIdentifier,
    floor(value * 4) / 4 - 50 AS MentionDocTone,
    (CAST(json_extract(props, '$.k') AS INTEGER) % 10 + 1) * 10 AS Confidence,
    CAST(ts AS DATE) AS part_day@EXTRA@
  FROM events"""

FX1_EVENTS = """
  SELECT DISTINCT GLOBALEVENTID,
    CAST(strftime(part_day, '%Y%m%d') AS BIGINT) * 1000000 + 180000 AS DATEADDED,
    'actor' || CAST(GLOBALEVENTID % 7 AS VARCHAR) AS Actor1Name,
    CASE WHEN GLOBALEVENTID % 3 = 0 THEN NULL
         ELSE 'actor' || CAST(GLOBALEVENTID % 5 AS VARCHAR) END AS Actor2Name,
    CAST(GLOBALEVENTID % 41 - 20 AS DOUBLE) / 2 AS GoldsteinScale,
    part_day
  FROM @MENTIONS@"""

FX1_CTES = ("\nfx_m AS (" + FX1_MENTIONS.replace("@EXTRA@", "") + "\n),"
            "\nfx_e AS (" + FX1_EVENTS.replace("@MENTIONS@", "fx_m") + "\n)")

# FX3: FX1 with the rows of user_id % 3 = 0 moved to one hot event (9999999,
# published 2024-01-05 18:00), which is added to the events table.
FX3_CTES = ("\nfx1_m AS (" + FX1_MENTIONS.replace("@EXTRA@", ",\n    user_id % 3 = 0 AS hot") + "\n),"
            "\nfx1_e AS (" + FX1_EVENTS.replace("@MENTIONS@", "fx1_m") + "\n)," + """
fx_m AS (
  SELECT CASE WHEN hot THEN CAST(9999999 AS BIGINT) ELSE GLOBALEVENTID END AS GLOBALEVENTID,
         CASE WHEN hot THEN CAST(20240105000000 AS BIGINT) ELSE EventTimeDate END AS EventTimeDate,
         MentionTimeDate, MentionSourceName, MentionIdentifier, MentionDocTone, Confidence, part_day
  FROM fx1_m
),
fx_e AS (
  SELECT * FROM fx1_e
  UNION ALL
  SELECT CAST(9999999 AS BIGINT), CAST(20240105180000 AS BIGINT), 'actor' || CAST(9999999 % 7 AS VARCHAR),
         CASE WHEN 9999999 % 3 = 0 THEN NULL ELSE 'actor' || CAST(9999999 % 5 AS VARCHAR) END,
         CAST(9999999 % 41 - 20 AS DOUBLE) / 2, DATE '2024-01-05'
)""")

FX2_CTES = """
fx_m AS (
  SELECT
    l_orderkey AS GLOBALEVENTID,
    CAST(strftime(o_orderdate, '%Y%m%d%H%M%S') AS BIGINT) AS EventTimeDate,
    CAST(strftime(o_orderdate, '%Y%m%d%H%M%S') AS BIGINT) AS MentionTimeDate,
    'supp' || CAST(l_suppkey AS VARCHAR) || '.example.com' AS MentionSourceName,
    'http://supp' || CAST(l_suppkey AS VARCHAR) || '.example.com/' || CAST(l_partkey AS VARCHAR)
      || '/' || CAST(l_linenumber AS VARCHAR) AS MentionIdentifier,
    l_quantity - 25 AS MentionDocTone,
    least(100, 30 + 10 * l_linenumber) AS Confidence,
    CAST(o_orderdate AS DATE) AS part_day
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
fx_e AS (
  SELECT o_orderkey AS GLOBALEVENTID,
    CAST(strftime(o_orderdate, '%Y%m%d%H%M%S') AS BIGINT) AS DATEADDED,
    'actor' || CAST(o_orderkey % 7 AS VARCHAR) AS Actor1Name,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL
         ELSE 'actor' || CAST(o_orderkey % 5 AS VARCHAR) END AS Actor2Name,
    CAST(o_orderkey % 41 - 20 AS DOUBLE) / 2 AS GoldsteinScale,
    CAST(o_orderdate AS DATE) AS part_day
  FROM orders
)"""

FIXTURE_CTES = {"fx1": FX1_CTES, "fx2": FX2_CTES, "fx3": FX3_CTES}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def selection_ctes(p: Params, fixture: str = "fx1") -> str:
    """CTEs fx_m, fx_e, seen, flat. ``seen`` has one row per event of the mentions of the partition
    window: whether any mention makes the event a candidate, and count and mean over its
    confident mentions; ``flat`` joins it once to mentions and events."""
    days = f"part_day >= DATE '{p.begin_day.isoformat()}' AND part_day < DATE '{p.end_day_exclusive.isoformat()}'"
    mdays, edays = days.replace("part_day", "m.part_day"), days.replace("part_day", "e.part_day")
    times = f"BETWEEN {p.begin_int} AND {p.end_int}"
    regex = f" AND regexp_matches(MentionIdentifier, {_q(p.filter_mention_id)})" if p.filter_mention_id else ""
    limit = "" if p.limit is None else f"""
  ORDER BY eventSourceCount DESC, eventId, mentionDateAdded, mentionSourceName NULLS LAST,
           mentionIdentifier NULLS LAST, mentionDocTone NULLS LAST
  LIMIT {p.limit}"""
    return FIXTURE_CTES[fixture] + f""",
seen AS (
  SELECT GLOBALEVENTID AS id, bool_or(EventTimeDate {times}{regex}) AS candidate,
         count(DISTINCT MentionSourceName) FILTER (WHERE Confidence >= {p.confidence}) AS sources,
         avg(MentionDocTone) FILTER (WHERE Confidence >= {p.confidence}) AS tone
  FROM fx_m WHERE {days} GROUP BY ALL
),
flat AS (
  SELECT id AS eventId, MentionTimeDate AS mentionDateAdded, MentionSourceName AS mentionSourceName,
         MentionIdentifier AS mentionIdentifier, MentionDocTone AS mentionDocTone,
         sources AS eventSourceCount, tone AS eventAvgTone, DATEADDED AS eventDateAdded,
         Actor1Name AS eventActor1, Actor2Name AS eventActor2, GoldsteinScale AS eventGoldsteingScale
  FROM seen, fx_m m, fx_e e
  WHERE candidate AND sources >= {p.minimum_distinct_source_count}
    AND m.GLOBALEVENTID = id AND {mdays} AND m.Confidence >= {p.confidence} AND MentionTimeDate {times}
    AND e.GLOBALEVENTID = id AND {edays}{limit}
)"""


def event_bodies(p: Params) -> dict[str, str]:
    """Final SELECTs over the selection CTEs for the parts before the flat table."""
    days = f"part_day >= DATE '{p.begin_day.isoformat()}' AND part_day < DATE '{p.end_day_exclusive.isoformat()}'"
    best = f"sources >= {p.minimum_distinct_source_count}"
    return {
        "ids": "SELECT id AS GLOBALEVENTID FROM seen WHERE candidate",
        "events": f"""SELECT GLOBALEVENTID, DATEADDED, Actor1Name, Actor2Name, GoldsteinScale
FROM fx_e SEMI JOIN (FROM seen WHERE candidate) ON id = GLOBALEVENTID WHERE {days}""",
        "best": f"SELECT id AS GLOBALEVENTID, sources AS distinctSourceCount, tone AS avgDocTone FROM seen WHERE {best}",
        "mentions": f"""SELECT GLOBALEVENTID, MentionTimeDate, MentionSourceName, MentionIdentifier, MentionDocTone,
       sources AS distinctSourceCount, tone AS avgDocTone
FROM fx_m JOIN seen ON id = GLOBALEVENTID
WHERE {best} AND {days} AND Confidence >= {p.confidence} AND MentionTimeDate BETWEEN {p.begin_int} AND {p.end_int}""",
    }


PREP_CTES = """,
full_t AS (
  SELECT eventId,
         strptime(CAST(mentionDateAdded AS VARCHAR), '%Y%m%d%H%M%S') AS mentionDateAdded,
         mentionSourceName, mentionIdentifier, mentionDocTone, eventSourceCount, eventAvgTone,
         strptime(CAST(eventDateAdded AS VARCHAR), '%Y%m%d%H%M%S') AS eventDateAdded,
         eventActor1, eventActor2, eventGoldsteingScale
  FROM flat
),
prep_ev AS (
  SELECT eventId,
    first(eventSourceCount ORDER BY mentionDateAdded NULLS FIRST, mentionIdentifier NULLS FIRST) FILTER (WHERE eventSourceCount IS NOT NULL) AS eventSourceCount,
    first(eventAvgTone ORDER BY mentionDateAdded NULLS FIRST, mentionIdentifier NULLS FIRST) FILTER (WHERE eventAvgTone IS NOT NULL) AS eventAvgTone,
    first(eventDateAdded ORDER BY mentionDateAdded NULLS FIRST, mentionIdentifier NULLS FIRST) FILTER (WHERE eventDateAdded IS NOT NULL) AS eventDateAdded,
    first(eventActor1 ORDER BY mentionDateAdded NULLS FIRST, mentionIdentifier NULLS FIRST) FILTER (WHERE eventActor1 IS NOT NULL) AS eventActor1,
    first(eventActor2 ORDER BY mentionDateAdded NULLS FIRST, mentionIdentifier NULLS FIRST) FILTER (WHERE eventActor2 IS NOT NULL) AS eventActor2,
    first(eventGoldsteingScale ORDER BY mentionDateAdded NULLS FIRST, mentionIdentifier NULLS FIRST) FILTER (WHERE eventGoldsteingScale IS NOT NULL) AS eventGoldsteingScale
  FROM full_t WHERE eventId IS NOT NULL GROUP BY eventId
),
prep_m AS (
  SELECT eventId, mentionDateAdded, mentionSourceName, mentionIdentifier, mentionDocTone
  FROM full_t
)"""

GRAPH_CTES = """,
tone AS (
  SELECT eventId, mentionSourceName,
         CAST(round_even(avg(mentionDocTone) * 100, 0) AS BIGINT) AS cents,
         first(mentionIdentifier ORDER BY mentionDateAdded NULLS FIRST, mentionIdentifier)
           FILTER (WHERE mentionIdentifier IS NOT NULL) AS mentionIdentifier
  FROM prep_m WHERE mentionSourceName IS NOT NULL
  GROUP BY eventId, mentionSourceName
),
top_src AS (
  SELECT mentionSourceName, count(*) AS mentionnedEventsCount,
         CAST(row_number() OVER (ORDER BY count(*) DESC, mentionSourceName) AS INTEGER) AS outlet_rank
  FROM tone GROUP BY mentionSourceName
  QUALIFY outlet_rank <= 40
),
filt AS (
  SELECT * FROM tone WHERE mentionSourceName IN (SELECT mentionSourceName FROM top_src)
),
pairs AS (
  SELECT a.eventId, a.mentionSourceName AS source1, b.mentionSourceName AS source2,
         a.cents AS avgTone1Cents, b.cents AS avgTone2Cents,
         a.mentionIdentifier AS url1, b.mentionIdentifier AS url2
  FROM filt a JOIN filt b ON a.eventId = b.eventId AND a.mentionSourceName < b.mentionSourceName
),
edges AS (
  SELECT source1, source2, count(*) AS eventsSharedCount,
         CAST(CAST(round_even(avg(abs(avgTone1Cents - avgTone2Cents)), 0) AS BIGINT) AS DOUBLE) / 100 AS meanToneDist
  FROM pairs GROUP BY source1, source2
)"""

STACKED_CTES = """,
dedup AS (
  SELECT eventId, split_part(mentionSourceName, '.', 1) AS mentionSourceName,
         CAST(date_trunc('hour', mentionDateAdded) AS TIMESTAMP) AS roundedMentionDate,
         first(coalesce(mentionDocTone - eventAvgTone > 0, false)
               ORDER BY mentionDateAdded NULLS FIRST, mentionIdentifier NULLS FIRST,
                        mentionDocTone NULLS FIRST) AS positiveTone
  FROM full_t
  WHERE mentionDateAdded <= (SELECT max(eventDateAdded) FROM full_t)
  GROUP BY ALL
),
nos AS (
  SELECT roundedMentionDate, eventId, CAST(count(mentionSourceName) - 1 AS BIGINT) AS numOtherSources
  FROM dedup GROUP BY roundedMentionDate, eventId
),
nos_tone AS (
  SELECT roundedMentionDate, eventId, positiveTone,
         CAST(count(mentionSourceName) - 1 AS BIGINT) AS numOtherSources
  FROM dedup GROUP BY roundedMentionDate, eventId, positiveTone
),
degree AS (
  SELECT d.roundedMentionDate, d.mentionSourceName, CAST(sum(n.numOtherSources) AS BIGINT) AS numOtherSources
  FROM dedup d JOIN nos n ON d.roundedMentionDate = n.roundedMentionDate AND d.eventId = n.eventId
  WHERE d.mentionSourceName IS NOT NULL
  GROUP BY d.roundedMentionDate, d.mentionSourceName
),
degree_tone AS (
  SELECT d.roundedMentionDate, d.mentionSourceName, (d.positiveTone = n.positiveTone) AS agreeing,
         CAST(sum(n.numOtherSources) AS BIGINT) AS numOtherSources
  FROM dedup d JOIN nos_tone n ON d.roundedMentionDate = n.roundedMentionDate AND d.eventId = n.eventId
  WHERE d.mentionSourceName IS NOT NULL
  GROUP BY d.roundedMentionDate, d.mentionSourceName, (d.positiveTone = n.positiveTone)
),
dom AS (
  SELECT mentionSourceName, count(*) AS eventsCount,
         CAST(row_number() OVER (ORDER BY count(*) DESC, mentionSourceName) AS INTEGER) AS outlet_rank
  FROM (SELECT DISTINCT eventId, mentionSourceName FROM dedup WHERE mentionSourceName IS NOT NULL)
  GROUP BY mentionSourceName
  QUALIFY outlet_rank <= 10
),
sg_hours AS (
  SELECT DISTINCT g.roundedMentionDate FROM degree g JOIN dom USING (mentionSourceName)
),
sg_long AS (
  SELECT h.roundedMentionDate AS mentionInterval, dom.mentionSourceName, dom.outlet_rank,
         CAST(coalesce(g.numOtherSources, 0) AS BIGINT) AS numOtherSources
  FROM sg_hours h CROSS JOIN dom
  LEFT JOIN degree g ON g.roundedMentionDate = h.roundedMentionDate
                    AND g.mentionSourceName = dom.mentionSourceName
),
dd AS (
  SELECT t.mentionSourceName, t.roundedMentionDate AS mentionInterval,
         CAST(coalesce(sum(t.numOtherSources) FILTER (WHERE t.agreeing), 0) AS BIGINT) AS "true",
         CAST(coalesce(sum(t.numOtherSources) FILTER (WHERE NOT t.agreeing), 0) AS BIGINT) AS "false"
  FROM degree_tone t WHERE t.mentionSourceName IN (SELECT mentionSourceName FROM dom)
  GROUP BY t.mentionSourceName, t.roundedMentionDate
)"""


def with_ctes(p: Params, body: str, fixture: str = "fx1", prep: bool = False,
              graph: bool = False, stacked: bool = False) -> str:
    ctes = selection_ctes(p, fixture)
    if prep or graph or stacked:
        ctes += PREP_CTES
    if graph:
        ctes += GRAPH_CTES
    if stacked:
        ctes += STACKED_CTES
    return "WITH " + ctes.strip() + "\n" + body.strip()


def wide_body() -> str:
    cols = ",\n  ".join(
        f"CAST(coalesce(sum(numOtherSources) FILTER (WHERE outlet_rank = {i}), 0) AS BIGINT) AS outlet_{i}"
        for i in range(1, 11))
    return f"SELECT mentionInterval,\n  {cols}\nFROM sg_long GROUP BY mentionInterval"
