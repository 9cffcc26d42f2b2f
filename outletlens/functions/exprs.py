"""Scalar column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def int_date_to_ts(col) -> Column:
    """``20240105061500`` (bigint) -> timestamp_ntz. A number that is no such date raises,
    whatever the session's ANSI setting; NULL stays NULL."""
    c = _c(col).cast("long")

    def digits(at: int, n: int) -> Column:
        return F.try_mod(F.floor(c / F.lit(10 ** at)), F.lit(10 ** n)).cast("int")

    time = F.try_make_timestamp_ntz(digits(10, 4), digits(8, 2), digits(6, 2), digits(4, 2), digits(2, 2),
                                    digits(0, 2).cast("decimal(8,6)"))
    sound = c.between(10 ** 13, 10 ** 14 - 1) & (digits(0, 2) < 60) & time.isNotNull()
    return F.when(c.isNull() | sound, time).otherwise(
        F.raise_error(F.concat(F.lit("not a date of the form yyyyMMddHHmmss: "), c.cast("string"))).cast("timestamp_ntz"))


def ts_to_int_date(col) -> Column:
    """timestamp -> ``yyyyMMddHHmmss`` bigint (fraction dropped)."""
    return F.translate(_seconds(col), "-: ", "").cast("long")


def _seconds(col) -> Column:
    """``2024-01-05 06:15:00``: a naive timestamp as text. Unlike date_trunc and date_format,
    the cast of a timestamp_ntz does not pass through the session's time zone, in
    which hours around a clock change do not exist or come twice."""
    return F.substring(_c(col).cast("string"), 1, 19)


def floor_time(col, unit: str = "HOUR") -> Column:
    """Floor to ``unit`` (SECOND up to YEAR) and stay timestamp_ntz."""
    kept = {"SECOND": 19, "MINUTE": 16, "HOUR": 13}.get(unit.upper())
    if kept is None:
        return F.trunc(_c(col).cast("date"), unit).cast("timestamp_ntz") if unit.upper() != "DAY" else \
            _c(col).cast("date").cast("timestamp_ntz")
    return F.concat(F.substring(_seconds(col), 1, kept), F.lit(":00:00"[:19 - kept])).cast("timestamp_ntz")


def space_z_label(col) -> Column:
    """``2024-01-05 06:00:00Z``: the hour labels of the stacked series."""
    return F.concat(_seconds(col), F.lit("Z"))


def iso_z_label(col) -> Column:
    """``2024-01-05T06:00:00Z``: timestamps inside JSON documents."""
    return F.concat(F.replace(_seconds(col), F.lit(" "), F.lit("T")), F.lit("Z"))


def nan_to_null(col) -> Column:
    """NaN -> NULL, so means skip it (as pandas does) and casts do not raise."""
    c = _c(col)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def to_cents(col) -> Column:
    """Round half-to-even at 2 decimals, carried as bigint hundredths:
    ``rint(x * 100)``, which is what numpy's ``round(x, 2)`` computes before its
    final division. Integer cents keep later sums exact and order-free."""
    return F.rint(_c(col) * F.lit(100.0)).cast("long")


def cents_to_double(col) -> Column:
    return _c(col).cast("double") / F.lit(100.0)


def short_outlet(col) -> Column:
    """Outlet short name: text before the first literal dot (whole name if no dot)."""
    return F.substring_index(_c(col), ".", 1)


def positive_tone(tone, event_avg) -> Column:
    """Mention more positive than its event's mean; NULL (NaN) compares false."""
    return F.coalesce(_c(tone) - _c(event_avg) > F.lit(0.0), F.lit(False))
