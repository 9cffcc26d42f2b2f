"""Hand-made micro frames (3-10 rows) for the semantic edge cases."""

from __future__ import annotations

from pyspark.sql import types as T

from outletlens.sources.tables import EVENTS_SCHEMA, FLAT_SCHEMA, MENTIONS_SCHEMA
from outletlens.sources.fixtures import SourceTables

FLAT_DEFAULTS = dict(eventId=1, mentionDateAdded=20240105100000, mentionSourceName="a.com",
                     mentionIdentifier=None, mentionDocTone=0.0, eventSourceCount=3,
                     eventAvgTone=0.0, eventDateAdded=20240106000000, eventActor1="x",
                     eventActor2=None, eventGoldsteingScale=1.0)


def flat(spark, rows, schema: T.StructType = FLAT_SCHEMA):
    """Flat frame; each row is a dict overriding FLAT_DEFAULTS."""
    names = schema.fieldNames()
    data = [tuple({**FLAT_DEFAULTS, **r}.get(n) for n in names) for r in rows]
    return spark.createDataFrame(data, schema)


def source_tables(spark, mentions, events):
    """Source tables from tuples in MENTIONS_SCHEMA / EVENTS_SCHEMA order."""
    return SourceTables(spark.createDataFrame(mentions, MENTIONS_SCHEMA),
                        spark.createDataFrame(events, EVENTS_SCHEMA))
