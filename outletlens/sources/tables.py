"""The two source tables and the flat contract.

Production layout: parquet (or any Spark table) partitioned by a DATE column
``part_day``, which stands for the warehouse's ingestion-time partition
(midnight of that day). Filters on ``part_day`` with literal bounds become
static PartitionFilters; the other predicates reach the scan as PushedFilters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART_COL = "part_day"

MENTIONS_SCHEMA = T.StructType([
    T.StructField("GLOBALEVENTID", T.LongType()),
    T.StructField("EventTimeDate", T.LongType()),
    T.StructField("MentionTimeDate", T.LongType()),
    T.StructField("MentionSourceName", T.StringType()),
    T.StructField("MentionIdentifier", T.StringType()),
    T.StructField("MentionDocTone", T.DoubleType()),
    T.StructField("Confidence", T.IntegerType()),
    T.StructField(PART_COL, T.DateType()),
])

EVENTS_SCHEMA = T.StructType([
    T.StructField("GLOBALEVENTID", T.LongType()),
    T.StructField("DATEADDED", T.LongType()),
    T.StructField("Actor1Name", T.StringType()),
    T.StructField("Actor2Name", T.StringType()),
    T.StructField("GoldsteinScale", T.DoubleType()),
    T.StructField(PART_COL, T.DateType()),
])

# Flat result: one row per mention of a selected event (the CSV dataset format;
# column names, including the spelling of the last one, are the output contract).
FLAT_SCHEMA = T.StructType([
    T.StructField("eventId", T.LongType()),
    T.StructField("mentionDateAdded", T.LongType()),
    T.StructField("mentionSourceName", T.StringType()),
    T.StructField("mentionIdentifier", T.StringType()),
    T.StructField("mentionDocTone", T.DoubleType()),
    T.StructField("eventSourceCount", T.LongType()),
    T.StructField("eventAvgTone", T.DoubleType()),
    T.StructField("eventDateAdded", T.LongType()),
    T.StructField("eventActor1", T.StringType()),
    T.StructField("eventActor2", T.StringType()),
    T.StructField("eventGoldsteingScale", T.DoubleType()),
])
FLAT_COLUMNS = [f.name for f in FLAT_SCHEMA.fields]


def read_mentions(spark: SparkSession, path: str) -> DataFrame:
    """Mentions table partitioned by ``part_day`` (partition discovery)."""
    return spark.read.parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events table partitioned by ``part_day``."""
    return spark.read.parquet(path)


def write_partitioned(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a source table in the production layout (one folder per day)."""
    df.write.mode(mode).partitionBy(PART_COL).parquet(path)


# --- bucketed layout ------------------------------------------------------------------

EVENT_COL = "GLOBALEVENTID"


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int) -> None:
    """Write a source table as ``table`` (files below ``path``): one folder per day, inside it one file
    per bucket of the event id, sorted by it. Grouping by event and joining on it then read their
    input in place: a task takes a bucket's files of all days of the window, and the mentions are
    never shuffled. ``buckets`` should be at least ``spark.sql.shuffle.partitions`` (else Spark
    may prefer to shuffle) and large enough that a bucket's window fits a task; an event is
    in one bucket however large it is, so data with an event that dominates its day is better
    kept unbucketed, where AQE splits it."""
    (df.repartition(buckets, EVENT_COL).write.mode("overwrite").format("parquet").option("path", path)
     .partitionBy(PART_COL).bucketBy(buckets, EVENT_COL).sortBy(EVENT_COL).saveAsTable(table))


def register_bucketed(spark: SparkSession, table: str, path: str, schema: T.StructType, buckets: int) -> DataFrame:
    """Make a bucketed layout written elsewhere known to this session's catalog, days that came
    since included, and read it."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet PARTITIONED BY ({PART_COL}) "
              f"CLUSTERED BY ({EVENT_COL}) SORTED BY ({EVENT_COL}) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    spark.catalog.recoverPartitions(table)
    return spark.table(table)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast/select to ``schema``; missing columns are an error."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
