"""Column expressions shared by the operators. All are built-in Spark
expressions (codegen'd, no Python UDF)."""

from outletlens.functions.exprs import (
    cents_to_double,
    floor_time,
    int_date_to_ts,
    iso_z_label,
    nan_to_null,
    positive_tone,
    short_outlet,
    space_z_label,
    to_cents,
    ts_to_int_date,
)
from outletlens.functions.keyed import first_non_null, group_scalar_filter, top_k

__all__ = [
    "cents_to_double", "floor_time", "int_date_to_ts", "iso_z_label", "nan_to_null",
    "positive_tone", "short_outlet", "space_z_label", "to_cents", "ts_to_int_date",
    "first_non_null", "group_scalar_filter", "top_k",
]
