"""Source tables derived from the driver's testdata (no synthetic data).

FX1 maps the ``events`` stream table onto mentions/events (many mentions per
event, 60 outlets, a 30-day span); FX3 is FX1 with a third of the mentions on
one hot event (skew); FX2 maps ``lineitem`` x ``orders`` onto them (many small
events, one outlet per supplier). All are lazy DataFrame
derivations; ``stage`` writes them once in the production layout (partitioned
by day) so that reads prune partitions exactly as on the real tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outletlens.functions.exprs import ts_to_int_date
from outletlens.functions.keyed import spread
from outletlens.session import fs_exists, fs_touch, scratch_path
from outletlens.sources.tables import (EVENTS_SCHEMA, MENTIONS_SCHEMA, PART_COL,
                                      conform, read_events, read_mentions,
                                      write_partitioned)

# --- fixed values of the fixture mapping ----------------------------------------
FX1_EPOCH = "2024-01-01"
FX1_EVENT_TYPE_NUMBERS = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}
FX1_OUTLETS = 60
FX1_EVENT_HOUR = 18            # events.DATEADDED = midnight of the day + 18 h
HOT_EVENT_ID = 9999999         # FX3: the event that receives a third of the mentions
HOT_EVENT_DAY = "2024-01-05"
# ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class SourceTables:
    """The two inputs of a selection."""

    mentions: DataFrame
    events: DataFrame


def _day_int(day: Column, hour: int = 0) -> Column:
    """A DATE as the yyyyMMddHHmmss integer of its midnight (+ ``hour`` hours)."""
    return F.date_format(day, "yyyyMMdd").cast("long") * F.lit(1000000) + F.lit(hour * 10000)


def _actors_and_scale(gid: Column) -> list[Column]:
    return [
        F.concat(F.lit("actor"), (gid % 7).cast("string")).alias("Actor1Name"),
        F.when(gid % 3 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("actor"), (gid % 5).cast("string"))).alias("Actor2Name"),
        ((gid % 41 - 20).cast("double") / F.lit(2.0)).alias("GoldsteinScale"),
    ]


def _fx1_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    type_no = F.lit(None).cast("int")
    for name, no in reversed(list(FX1_EVENT_TYPE_NUMBERS.items())):
        type_no = F.when(F.col("event_type") == name, F.lit(no)).otherwise(type_no)
    day = F.to_date(F.col("ts"))
    gid = (F.datediff(day, F.lit(FX1_EPOCH).cast("date")).cast("long") * 10 + type_no)
    return raw.select("*", gid.alias("GLOBALEVENTID"), day.alias(PART_COL))


def _fx1_mentions(base: DataFrame, hot: Column | None = None) -> DataFrame:
    """FX1 mention columns; rows where ``hot`` holds become mentions of the hot
    event (FX3)."""
    outlet = (F.col("user_id") % FX1_OUTLETS).cast("string")
    k = F.get_json_object(F.col("props"), "$.k").cast("int")
    gid = F.col("GLOBALEVENTID")
    event_time = _day_int(F.col(PART_COL))
    if hot is not None:
        gid = F.when(hot, F.lit(HOT_EVENT_ID).cast("long")).otherwise(gid)
        event_time = F.when(hot, _day_int(F.lit(HOT_EVENT_DAY).cast("date"))).otherwise(event_time)
    return base.select(
        gid.alias("GLOBALEVENTID"),
        event_time.alias("EventTimeDate"),
        ts_to_int_date(F.col("ts")).alias("MentionTimeDate"),
        F.concat(F.lit("site"), outlet, F.lit(".example.com")).alias("MentionSourceName"),
        F.concat(F.lit("http://site"), outlet, F.lit(".example.com/"), F.col("event_type"),
                 F.lit("/"), F.col("event_id").cast("string")).alias("MentionIdentifier"),
        (F.floor(F.col("value") * 4) / F.lit(4.0) - F.lit(50.0)).alias("MentionDocTone"),
        ((k % 10 + 1) * 10).alias("Confidence"),
        F.col(PART_COL),
    )


def _fx1_events(base: DataFrame) -> DataFrame:
    gid = F.col("GLOBALEVENTID")
    return (base.select("GLOBALEVENTID", PART_COL).distinct()
            .select(gid, _day_int(F.col(PART_COL), FX1_EVENT_HOUR).alias("DATEADDED"),
                    *_actors_and_scale(gid), F.col(PART_COL)))


def fx1_tables(spark: SparkSession, sf_dir: str) -> SourceTables:
    """FX1: one mention per ``events`` row; event = (day, event_type)."""
    base = _fx1_base(spark, sf_dir)
    return SourceTables(conform(_fx1_mentions(base), MENTIONS_SCHEMA),
                        conform(_fx1_events(base), EVENTS_SCHEMA))


def fx3_tables(spark: SparkSession, sf_dir: str) -> SourceTables:
    """FX3 (skew): FX1 where every row with ``user_id % 3 = 0`` is a mention of
    one hot event (published on 2024-01-05, mentioned on every day), so about a
    third of all mentions share one key. The events table is FX1's plus the hot
    event's row."""
    base = _fx1_base(spark, sf_dir)
    mentions = _fx1_mentions(base, hot=(F.col("user_id") % 3 == 0))
    gid = F.lit(HOT_EVENT_ID).cast("long")
    day = F.lit(HOT_EVENT_DAY).cast("date")
    hot_event = spark.range(1).select(
        gid.alias("GLOBALEVENTID"), _day_int(day, FX1_EVENT_HOUR).alias("DATEADDED"),
        *_actors_and_scale(gid), day.alias(PART_COL))
    events = _fx1_events(base).unionByName(hot_event)
    return SourceTables(conform(mentions, MENTIONS_SCHEMA), conform(events, EVENTS_SCHEMA))


def fx2_tables(spark: SparkSession, sf_dir: str) -> SourceTables:
    """FX2: one mention per ``lineitem`` row, event = its order, outlet = supplier."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate")
    # the selection aggregates and joins by event where this join leaves the rows
    rows = li.count()
    j = spread(li, "l_orderkey", rows).join(spread(orders, "o_orderkey", rows), F.col("l_orderkey") == F.col("o_orderkey"))
    supp = F.col("l_suppkey").cast("string")
    mentions = j.select(
        F.col("l_orderkey").alias("GLOBALEVENTID"),
        ts_to_int_date(F.col("o_orderdate")).alias("EventTimeDate"),
        ts_to_int_date(F.col("o_orderdate")).alias("MentionTimeDate"),
        F.concat(F.lit("supp"), supp, F.lit(".example.com")).alias("MentionSourceName"),
        F.concat(F.lit("http://supp"), supp, F.lit(".example.com/"),
                 F.col("l_partkey").cast("string"), F.lit("/"),
                 F.col("l_linenumber").cast("string")).alias("MentionIdentifier"),
        (F.col("l_quantity") - F.lit(25.0)).alias("MentionDocTone"),
        F.least(F.lit(100), F.lit(30) + F.lit(10) * F.col("l_linenumber")).alias("Confidence"),
        F.to_date(F.col("o_orderdate")).alias(PART_COL),
    )
    gid = F.col("o_orderkey")
    events = orders.select(
        gid.alias("GLOBALEVENTID"), ts_to_int_date(F.col("o_orderdate")).alias("DATEADDED"),
        *_actors_and_scale(gid), F.to_date(F.col("o_orderdate")).alias(PART_COL))
    return SourceTables(conform(mentions, MENTIONS_SCHEMA), conform(events, EVENTS_SCHEMA))


FIXTURES = {"fx1": fx1_tables, "fx2": fx2_tables, "fx3": fx3_tables}


def stage(spark: SparkSession, name: str, sf_dir: str, root: str | None = None) -> SourceTables:
    """Write a fixture once in the production layout (partitioned by day) below
    the shared checkpoint folder and return readers over it. Idempotent: a
    ``_READY`` marker is written last and checked first."""
    if root is None:
        tag = sf_dir.rstrip("/").replace("/", "_").strip("_")
        root = scratch_path(spark, "staged", f"{name}_{tag}")
    marker = f"{root}/_READY"
    if not fs_exists(spark, marker):
        tables = FIXTURES[name](spark, sf_dir)
        write_partitioned(tables.mentions, f"{root}/mentions")
        write_partitioned(tables.events, f"{root}/events")
        fs_touch(spark, marker)
    return SourceTables(read_mentions(spark, f"{root}/mentions"),
                        read_events(spark, f"{root}/events"))
