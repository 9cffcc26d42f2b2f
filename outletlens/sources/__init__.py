"""Sources (partitioned source tables, fixtures, CSV datasets) and sinks
(CSV, JSON and parquet result parts)."""
