"""Query parameters of one selection, parsed once on the driver.

Every derived bound (integer timestamps, partition days) becomes a literal in
the plan, so the partition filter is static and prunes at planning time.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from dataclasses import dataclass, replace

# --- fixed values (must equal the reference's for the same results) ---------
# Default parameter set, input timestamp format, integer yyyyMMddHHmmss date format.
DATE_BEGIN_DEFAULT = "2018-11-21T00:00:00.000Z"
DATE_END_DEFAULT = "2018-11-22T00:00:00.000Z"
MINIMUM_DISTINCT_SOURCE_COUNT_DEFAULT = 10
CONFIDENCE_DEFAULT = 100
LIMIT_DEFAULT = 100000
FILTER_MENTION_ID_DEFAULT = ""
ISO_INPUT_FORMAT = "%Y-%m-%dT%H:%M:%S.%fZ"
INT_DATE_FORMAT = "%Y%m%d%H%M%S"
# Parameter sets of the saved datasets: begin, end, min sources, confidence,
# limit, URL regex.
DATASET_PRESETS = {
    "gilets_jaunes_2018_11_30": ("2018-11-30T00:00:00.000Z", "2018-12-02T23:59:00.000Z", 3, 100, 100000, "gilet.*jaune"),
    "gilets_jaunes_2018_12_07": ("2018-12-07T00:00:00.000Z", "2018-12-08T23:59:00.000Z", 3, 100, 100000, "gilet.*jaune"),
    "gilets_jaunes_2018_12_10": ("2018-12-10T00:00:00.000Z", "2018-12-11T23:59:00.000Z", 3, 100, 100000, "gilet.*jaune"),
    "us_election_2016_11_08": ("2016-11-08T00:00:00.000Z", "2016-11-09T23:59:00.000Z", 50, 100, 100000, "trump.*elec"),
    "khashoggi_2018_10_20": ("2018-10-20T00:00:00.000Z", "2018-10-21T23:59:00.000Z", 20, 100, 100000, "khashoggi"),
}
# Analysis constants: outlets kept in the graph, outlets in the time series,
# time grain of the series.
GRAPH_TOP_OUTLETS = 40
STACKED_TOP_OUTLETS = 10
STACKED_TIME_UNIT = "HOUR"
# -----------------------------------------------------------------------------


def parse_iso(text: str) -> dt.datetime:
    """``2018-11-21T00:00:00.000Z`` -> naive datetime (UTC meant). The fraction
    and the ``Z`` are required, as in the reference's parser."""
    return dt.datetime.strptime(text, ISO_INPUT_FORMAT)


@dataclass(frozen=True)
class Params:
    """One selection: time window, distinct-source floor, confidence floor,
    row limit (``None`` = no limit) and an optional URL regex ("" = none)."""

    date_begin: str = DATE_BEGIN_DEFAULT
    date_end: str = DATE_END_DEFAULT
    minimum_distinct_source_count: int = MINIMUM_DISTINCT_SOURCE_COUNT_DEFAULT
    confidence: int = CONFIDENCE_DEFAULT
    limit: int | None = LIMIT_DEFAULT
    filter_mention_id: str = FILTER_MENTION_ID_DEFAULT

    def __post_init__(self):
        parse_iso(self.date_begin)
        parse_iso(self.date_end)
        if self.limit is not None and self.limit < 0:
            raise ValueError("limit must be >= 0 or None")

    # -- derived literals ----------------------------------------------------
    @property
    def begin(self) -> dt.datetime:
        return parse_iso(self.date_begin)

    @property
    def end(self) -> dt.datetime:
        return parse_iso(self.date_end)

    @property
    def begin_int(self) -> int:
        """Begin as a ``yyyyMMddHHmmss`` integer (closed lower bound)."""
        return int(self.begin.strftime(INT_DATE_FORMAT))

    @property
    def end_int(self) -> int:
        """End as a yyyyMMddHHmmss integer (closed upper bound)."""
        return int(self.end.strftime(INT_DATE_FORMAT))

    @property
    def begin_day(self) -> dt.date:
        """First partition day: the begin truncated to its day."""
        return self.begin.date()

    @property
    def end_day_exclusive(self) -> dt.date:
        """First partition day *not* read. A partition stands for midnight of its
        day and is read while midnight < raw end: so the end's own day is read
        unless the end is exactly midnight."""
        end = self.end
        if end == dt.datetime(end.year, end.month, end.day):
            return end.date()
        return end.date() + dt.timedelta(days=1)

    def with_(self, **changes) -> "Params":
        return replace(self, **changes)

    def id_text(self, source: str = "", tasks: str = "") -> str:
        """Readable form of the full parameter set, the data source and the tasks; JSON,
        so that no value can run into the next one."""
        return json.dumps([self.date_begin, self.date_end, self.minimum_distinct_source_count,
                           self.confidence, self.limit, self.filter_mention_id, source, tasks])

    def query_id(self, source: str = "", tasks: str = "") -> str:
        """Cache key: SHA-256 of the parameter text, safe as a folder name for any
        regex (slashes, quotes)."""
        return hashlib.sha256(self.id_text(source, tasks).encode("utf-8")).hexdigest()


def preset(name: str) -> Params:
    """One of the saved datasets' parameter sets (``DATASET_PRESETS``)."""
    return Params(*DATASET_PRESETS[name])
