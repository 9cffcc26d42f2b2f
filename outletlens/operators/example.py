"""Example analysis: the most covered events and their mentions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outletlens.functions.keyed import bounded_side, top_k

EXAMPLE_TOP_EVENTS = 10  # fixed value: events kept by the example analysis


def best_events(events: DataFrame, keys: Sequence[str] = (),
                n: int = EXAMPLE_TOP_EVENTS) -> DataFrame:
    """Top ``n`` events by ``eventSourceCount`` (ties by eventId)."""
    return top_k(events, keys, [F.col("eventSourceCount").desc_nulls_last(),
                                F.col("eventId").asc()], n)


def best_mentions(mentions: DataFrame, best: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mentions of those events (broadcast semi-join: at most n ids per key).
    The reference sorts them by (eventId, mentionDateAdded); that is a
    presentation order, applied at a sink only (``write_parts(ordered=True)``)."""
    return mentions.join(bounded_side(best.select(*keys, "eventId"), keys), [*keys, "eventId"],
                         "left_semi")


def example(events: DataFrame, mentions: DataFrame,
            keys: Sequence[str] = ()) -> dict[str, DataFrame]:
    best = best_events(events, keys)
    return {"best_events": best, "mentions": best_mentions(mentions, best, keys)}
