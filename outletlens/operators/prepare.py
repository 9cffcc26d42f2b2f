"""Split of the flat table into the three inputs of every analysis."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outletlens.functions.exprs import int_date_to_ts, nan_to_null
from outletlens.functions.keyed import first_non_null

DATE_COLUMNS = ("mentionDateAdded", "eventDateAdded")


@dataclass(frozen=True)
class Prepared:
    """``full`` (flat rows, dates parsed), ``events`` (one row per event) and
    ``mentions`` (one row per mention), plus the dataset keys they carry."""

    full: DataFrame
    events: DataFrame
    mentions: DataFrame
    keys: tuple[str, ...] = ()


def parse_dates(flat: DataFrame) -> DataFrame:
    """integer yyyyMMddHHmmss dates -> timestamp_ntz; NaN -> NULL in double columns."""
    out = flat
    for c in DATE_COLUMNS:
        if c in out.columns and not isinstance(out.schema[c].dataType,
                                               (T.TimestampNTZType, T.TimestampType)):
            out = out.withColumn(c, int_date_to_ts(c))
    for f in out.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            out = out.withColumn(f.name, nan_to_null(f.name))
    return out


def route_columns(columns: Sequence[str], token: str, keys: Sequence[str] = ()) -> list[str]:
    """Columns whose lower-cased name contains ``token`` (``event``/``mention``),
    in their original order; extra columns such as ``eventFoo`` follow the rule."""
    return [c for c in columns if token in c.lower() and c not in keys]


def first_row_order():
    """Order that stands for the reference's (arbitrary) frame order."""
    return F.struct(F.col("mentionDateAdded"), F.col("mentionIdentifier"))


def prepare(flat: DataFrame, keys: Sequence[str] = ()) -> Prepared:
    """Parse dates and split: events = first non-null value of every event column
    per event; mentions = ``eventId`` + mention columns, one row per mention."""
    keys = tuple(keys)
    full = parse_dates(flat)
    event_cols = route_columns(full.columns, "event", keys)
    mention_cols = route_columns(full.columns, "mention", keys)
    order = first_row_order()
    events = (full.where(F.col("eventId").isNotNull())  # groupby drops null keys
              .groupBy(*keys, "eventId")
              .agg(*[first_non_null(c, order).alias(c) for c in event_cols if c != "eventId"]))
    mentions = full.select(*keys, "eventId", *mention_cols)
    return Prepared(full, events, mentions, keys)
