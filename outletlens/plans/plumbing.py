"""Round trips through the sinks, used as registered queries: each writes to a
fresh folder below the shared checkpoint folder and returns what it reads
back, so the result can be checked against the unwritten query."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outletlens.operators.selection import select_flat
from outletlens.params import Params
from outletlens.plans.batch import run_all_datasets
from outletlens.plans.incremental import update_datasets
from outletlens.plans.pipeline import run_pipeline
from outletlens.plans.tasks import (TASKS, ExampleTask, GraphTask, StackedGraphTask, Task,
                                   run_dataset_pipeline)
from outletlens.session import materialise, scratch_path
from outletlens.sources.documents import read_graph_document, write_graph_document
from outletlens.sources.files import read_flat_csv, read_json, read_ordered, write_flat_csv, write_json, write_parts
from outletlens.sources.fixtures import SourceTables
from outletlens.sources.tables import read_events, read_mentions, write_bucketed, write_partitioned


def fresh_dir(spark: SparkSession, kind: str) -> str:
    return scratch_path(spark, kind, uuid.uuid4().hex)


def task_registry(spark: SparkSession, flat: DataFrame) -> DataFrame:
    """Rows per (task, part) of every registered task plus the example task,
    computed as one union of counts (one job; shared exchanges are reused)."""
    results = run_dataset_pipeline(materialise(flat), (*TASKS, ExampleTask()))
    counts = [df.agg(F.count(F.lit(1)).alias("rows"))
                .select(F.lit(task).alias("task"), F.lit(part).alias("part"), "rows")
              for task, parts in results.items() for part, df in parts.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def csv_roundtrip(spark: SparkSession, flat: DataFrame) -> DataFrame:
    path = fresh_dir(spark, "csv") + "/flat.csv"
    write_flat_csv(flat, path)
    return read_flat_csv(spark, path)


DRILLDOWN_JSON_SCHEMA = T.StructType([
    T.StructField("mentionSourceName", T.StringType()),
    T.StructField("mentionInterval", T.StringType()),
    T.StructField("true", T.LongType()),
    T.StructField("false", T.LongType()),
])


def json_roundtrip(spark: SparkSession, drilldown: DataFrame) -> DataFrame:
    path = fresh_dir(spark, "json") + "/drilldown"
    write_json(drilldown, path)
    return read_json(spark, path, DRILLDOWN_JSON_SCHEMA)


def nested_json_roundtrip(spark: SparkSession, nested: DataFrame) -> DataFrame:
    """``drilldown_nested`` as JSON documents, read back and taken apart."""
    path = fresh_dir(spark, "json") + "/drilldown_nested"
    write_json(nested, path)
    records = T.ArrayType(T.StructType(DRILLDOWN_JSON_SCHEMA.fields[1:]))
    schema = T.StructType([DRILLDOWN_JSON_SCHEMA.fields[0], T.StructField("records", records)])
    return read_json(spark, path, schema).select("mentionSourceName", F.inline("records"))


def batch_datasets(spark: SparkSession, flats: Mapping[str, DataFrame], task: str = "graph",
                   part: str = "edges") -> DataFrame:
    """Save each flat table as ``<name>.csv``, then compute one part for all of
    them in one keyed job (``dataset`` is the leading key everywhere)."""
    root = fresh_dir(spark, "datasets")
    for name, flat in flats.items():
        write_flat_csv(flat, f"{root}/{name}.csv")
    return run_all_datasets(spark, root, tasks=PART_TASKS[task])[task][part]


def cache_hit(spark: SparkSession, tables: SourceTables, params: Params, source: str,
              then: SourceTables | None = None, refresh: bool = False) -> DataFrame:
    """Run the cached pipeline twice, the second time over ``then`` (default: the same
    tables) under the same source name: served from the cache unless refreshed.
    An empty selection is flagged and not cached; the edges are then those of
    the (empty) selection itself."""
    root = fresh_dir(spark, "cache")
    run_pipeline(spark, tables, params, root, source=source)
    last = tables if then is None else then
    res = run_pipeline(spark, last, params, root, source=source, refresh=refresh)
    if "empty" in res:
        return run_dataset_pipeline(select_flat(last, params), (GraphTask(),))["graph"]["edges"]
    return res["graph"]["edges"]


def cache_appended(spark: SparkSession, tables: SourceTables, params: Params, source: str) -> DataFrame:
    """Run the cached pipeline over half of the mentions, append the others to the table and run it
    again under the same name: the appended files are another snapshot, so nothing stale comes back."""
    root = fresh_dir(spark, "appended")
    write_partitioned(tables.events, f"{root}/events")
    half = F.xxhash64("GLOBALEVENTID", "MentionTimeDate", "MentionIdentifier") % 2 == 0
    for mode, part in (("overwrite", tables.mentions.where(half)), ("append", tables.mentions.where(~half))):
        write_partitioned(part, f"{root}/mentions", mode)
        now = SourceTables(read_mentions(spark, f"{root}/mentions"), read_events(spark, f"{root}/events"))
        res = run_pipeline(spark, now, params, f"{root}/cache", source=source)
    return res["graph"]["edges"]


def graph_document(spark: SparkSession, flat: DataFrame, part: str = "edge_events") -> DataFrame:
    """The graph task's parts as one nested document, and one part read back from it."""
    path = fresh_dir(spark, "document")
    write_graph_document(run_dataset_pipeline(materialise(flat), (GraphTask(),))["graph"], path)
    return read_graph_document(spark, path)[part]


def ordered_part(spark: SparkSession, flat: DataFrame, task: Task, part: str) -> DataFrame:
    """A part written in its presentation order and read back with each row's place in it."""
    root = fresh_dir(spark, "ordered")
    parts = run_dataset_pipeline(materialise(flat), (task,))[task.task_name]
    [path] = write_parts({task.task_name: {part: parts[part]}}, root, ordered=True)
    return read_ordered(spark, path)


def bucketed_selection(spark: SparkSession, tables: SourceTables, params: Params, buckets: int = 8) -> DataFrame:
    """The selection over both tables in the bucketed layout."""
    return select_flat(bucketed_tables(spark, tables, buckets), params)


def bucketed_tables(spark: SparkSession, tables: SourceTables, buckets: int) -> SourceTables:
    tag = uuid.uuid4().hex
    out = []
    for name, df in (("mentions", tables.mentions), ("events", tables.events)):
        write_bucketed(df, f"{name}_{tag}", scratch_path(spark, "bucketed", tag, name), buckets)
        out.append(spark.table(f"{name}_{tag}"))
    return SourceTables(*out)


def batch_incremental(spark: SparkSession, flats: Mapping[str, DataFrame], task: str = "graph", part: str = "edges") -> DataFrame:
    """Each flat table is saved in two files, the second one after a first run of the incremental
    batch; the results after the second run, which reads the new files only."""
    root = fresh_dir(spark, "arriving")
    second = F.pmod(F.xxhash64("mentionIdentifier", "mentionDateAdded"), F.lit(2)) == 1
    saved = {name: materialise(flat) for name, flat in flats.items()}
    for late in (False, True):
        for name, flat in saved.items():
            write_flat_csv(flat.where(second if late else ~second), f"{root}/datasets/{name}.csv", mode="append")
        update_datasets(spark, f"{root}/datasets", f"{root}/state", f"{root}/results")
    schema = run_dataset_pipeline(next(iter(saved.values())).withColumn("dataset", F.lit("")), PART_TASKS[task], keys=("dataset",))[task][part].schema
    return spark.read.schema(schema).parquet(f"{root}/results/{task}/{part}")


PART_TASKS = {"graph": (GraphTask(),), "stackedGraph": (StackedGraphTask(),)}
