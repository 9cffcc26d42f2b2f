"""File sources and sinks: CSV datasets, JSON documents, parquet result parts.

Paths go through Spark/Hadoop (any file system the cluster mounts); the only
driver-side file operations are existence checks, listings and markers.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outletlens.functions.exprs import iso_z_label
from outletlens.session import side_by_side
from outletlens.sources.tables import FLAT_SCHEMA, PART_COL


# --- CSV datasets (the reference's saved query results) -------------------------------

# Quotes are doubled inside quoted fields, which may hold newlines (so a file is one
# split: results are computed on a parquet copy); a broken row or a header other than
# the schema raises.
CSV_FORM = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
CSV_READ = {**CSV_FORM, "multiLine": True, "mode": "FAILFAST", "enforceSchema": False}


def write_flat_csv(flat: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Unprocessed flat table as CSV with a header row and no index column."""
    flat.write.mode(mode).options(**CSV_FORM).csv(path)


def read_flat_csv(spark: SparkSession, path: str,
                  schema: T.StructType = FLAT_SCHEMA) -> DataFrame:
    """Flat CSV with an explicit schema (never inferred). Pass an extended schema
    for files with extra columns such as ``eventFoo``."""
    return spark.read.schema(schema).options(**CSV_READ).csv(path)


def qualified(spark: SparkSession, path: str) -> str:
    """Fully qualified form of ``path`` (as it appears in ``_metadata.file_path``)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return str(fs.makeQualified(p).toString()).rstrip("/")


def name_below(spark: SparkSession, root: str, path: Column) -> Column:
    """Dataset name of the file ``path`` below ``root``: the first path component below
    ``root`` up to its first dot. A plain file ``root/khashoggi.csv`` and a
    Spark-written folder ``root/khashoggi.csv/part-*`` both give ``khashoggi``."""
    prefix = qualified(spark, root) + "/"
    rel = F.substring(F.regexp_replace(path, "^(\\w+:)/*", "$1/"), len(re.sub(r"^(\w+:)/*", r"\1/", prefix)) + 1, 1 << 30)
    return F.substring_index(F.substring_index(rel, "/", 1), ".", 1)


def dataset_name(spark: SparkSession, root: str) -> Column:
    """``name_below`` of the file a row was read from."""
    # the metadata path is percent-encoded; a plus sign in it stands for itself
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return name_below(spark, root, path)


def read_dataset_dir(spark: SparkSession, root: str, schema: T.StructType = FLAT_SCHEMA,
                     name_col: str = "dataset") -> DataFrame:
    """Every CSV dataset below ``root`` in one scan, with a ``dataset`` column
    (see ``dataset_name``). Every file is read, whatever its name; one that is not
    such a dataset raises."""
    df = spark.read.schema(schema).options(**CSV_READ).option("recursiveFileLookup", True).csv(root)
    return df.select(dataset_name(spark, root).alias(name_col), *schema.fieldNames())


# --- JSON documents -----------------------------------------------------------------

def _document(col: Column, kind: T.DataType) -> Column:
    """``col`` with every timestamp in it, at any depth, in the document format."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return iso_z_label(col)
    if "timestamp" not in kind.simpleString():
        return col
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: _document(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(col, lambda _, x: _document(x, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(col.isNotNull(), F.struct(*[_document(col[f.name], f.dataType).alias(f.name) for f in kind]))
    return col


def json_ready(df: DataFrame) -> DataFrame:
    """Timestamps -> ``yyyy-MM-ddTHH:mm:ssZ`` strings (the document format), nested
    ones too; NaN is already NULL (set at ingest), and NULLs are written as ``null``."""
    return df.select(*[_document(F.col(f.name), f.dataType).alias(f.name) for f in df.schema])


def write_json(df: DataFrame, path: str, mode: str = "overwrite",
               partition_by: Sequence[str] = ()) -> None:
    w = json_ready(df).write.mode(mode).option("ignoreNullFields", False)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


# --- result parts (parquet) -----------------------------------------------------------

def presentation_order(part: str, df: DataFrame, keys: Sequence[str] = ()) -> list:
    """Order in which the reference presents a part (nodes by event count
    descending, mentions by event and date, hourly parts by hour, pivots by
    their keys). Applied only at a sink, as a global sort (range partitioning),
    never inside a plan."""
    desc_first = {"nodes": ["mentionnedEventsCount"], "best_events": ["eventSourceCount"],
                  "dom_outlets": ["eventsCount"]}
    by = {"nodes": ["mentionSourceName"], "edges": ["source1", "source2"],
          "edge_events": ["source1", "source2", "eventId"], "dates": ["mentionInterval"],
          "streamgraph": ["mentionInterval", "mentionSourceName"],
          "streamgraph_wide": ["mentionInterval"],
          "drilldown": ["mentionSourceName", "mentionInterval"],
          "streamgraph_nested": ["mentionInterval"], "drilldown_nested": ["mentionSourceName"], "edges_nested": ["source1"],
          "mentions": ["eventId", "mentionDateAdded"], "best_events": ["eventId"],
          "dom_outlets": ["outlet_rank"]}
    cols = [F.col(k) for k in keys]
    cols += [F.col(c).desc() for c in desc_first.get(part, []) if c in df.columns]
    cols += [F.col(c).asc() for c in by.get(part, []) if c in df.columns]
    used = {*keys, *desc_first.get(part, []), *by.get(part, [])}
    # the other plain columns break ties, so that the order is total
    cols += [F.col(f.name).asc_nulls_first() for f in df.schema
             if cols and f.name not in used and isinstance(f.dataType, T.AtomicType)]
    return cols


def write_parts(results: Mapping[str, Mapping[str, DataFrame]], root: str, fmt: str = "parquet",
                partition_by: Sequence[str] = (), mode: str = "overwrite",
                dynamic: bool = False, ordered: bool = False, workers: int = 4) -> list[str]:
    """Write every ``task/part`` below ``root``; returns the written paths.
    ``dynamic`` replaces only the ``partition_by`` values present in the data
    (dynamic partition overwrite), leaving the other datasets' results.
    ``ordered`` writes each part in its presentation order (files in order).
    Parts are jobs of their own, ``workers`` of them at a time."""
    def write(part: str, df: DataFrame, path: str) -> str:
        if ordered:
            order = presentation_order(part, df)
            df = df.orderBy(*order) if order else df
        w = (json_ready(df) if fmt == "json" else df).write.mode(mode)
        if fmt == "json":
            w = w.option("ignoreNullFields", False)
        if dynamic:
            w = w.option("partitionOverwriteMode", "dynamic")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.format(fmt).save(path)
        return path

    return side_by_side([lambda part=part, df=df, path=f"{root}/{task}/{part}": write(part, df, path)
                         for task, parts in results.items() for part, df in parts.items()], workers)


def read_ordered(spark: SparkSession, path: str, rank: str = "rank") -> DataFrame:
    """A parquet part that was written in order, with each row's number from 1 in that order:
    files follow each other by name, rows inside a file by position. Only a count per file is
    summed over all files, no row is sorted."""
    at = [F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    rows = spark.read.parquet(path)
    rows = rows.select(*rows.columns, *at)
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    starts = (rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
              .select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    return (rows.join(starts, "_file").withColumn(rank, F.col("_start") + F.col("_row") + 1)
            .drop("_file", "_row", "_start"))


# --- what a table's files are ---------------------------------------------------------

def literal(path: str) -> str:
    """``path`` with nothing in it taken for a wildcard."""
    return re.sub(r"([\\[\]{}*?])", r"\\\1", path)


def file_list(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, length, changed) of the files ``paths`` or the files below these folders; their
    contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load([literal(p) for p in paths])
            .select("path", "length", F.unix_micros("modificationTime").alias("changed")))


def snapshot(spark: SparkSession, tables: Sequence[DataFrame], days: tuple[str, str] | None = None) -> str:
    """Fingerprint of the files that ``tables`` read: their paths, sizes and times of change. With
    ``days`` (first, first not read; ISO) only files of these partition days count, and files
    outside any day's folder. Tables that read no files have an empty one."""
    paths = sorted({unquote(f) for t in tables for f in t.inputFiles()})
    if days:
        day = {p: m[1] if (m := re.search(rf"/{PART_COL}=(\d{{4}}-\d\d-\d\d)/", p)) else None for p in paths}
        paths = [p for p in paths if day[p] is None or days[0] <= day[p] < days[1]]
    if not paths:
        return ""
    each = F.xxhash64("path", "length", "changed").cast("decimal(38,0)")
    n, total = file_list(spark, paths).agg(F.count(F.lit(1)), F.sum(each)).first()
    return f"{n}:{total}"


def list_dirs(spark: SparkSession, path: str) -> list[str]:
    """Names of the sub-folders of ``path`` (Hadoop listing; no data read)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return sorted(str(s.getPath().getName()) for s in fs.listStatus(p)
                  if s.isDirectory() and not str(s.getPath().getName()).startswith(("_", ".")))


def read_parts(spark: SparkSession, root: str, fmt: str = "parquet",
               skip: Sequence[str] = ("flat",)) -> dict[str, dict[str, DataFrame]]:
    """Inverse of ``write_parts`` (parquet keeps the exact types)."""
    out: dict[str, dict[str, DataFrame]] = {}
    for task in list_dirs(spark, root):
        if task in skip:
            continue
        out[task] = {part: spark.read.format(fmt).load(f"{root}/{task}/{part}")
                     for part in list_dirs(spark, f"{root}/{task}")}
    return out
