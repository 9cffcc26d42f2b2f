"""End-to-end run of one parameter set, cached by its full parameter set and its inputs.

The cache key holds the parameters, the tasks and a fingerprint of the files that the tables
read for the window's days, so changed or appended tables are another key and nothing stale is
served. On a miss the selection is written once as a parquet table in a fresh folder
and read back (one computation, lineage cut at a shared, fault-tolerant copy), every
registered task part is written next to it, and only then the folder is published by an empty
marker file, whose creation is one atomic operation on any store. Readers take the newest
published folder: a run that fails leaves the served result as it is, and of two runs that race
the one published last is served. On a hit the parts are read back. An empty selection is
reported as ``{"empty": True}`` and not cached.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from outletlens.operators.selection import select_flat
from outletlens.params import Params
from outletlens.plans.tasks import TASKS, Task, run_dataset_pipeline
from outletlens.session import fs_delete, fs_list, fs_touch, materialise, owned_tables
from outletlens.sources.files import list_dirs, read_flat_csv, read_parts, snapshot, write_flat_csv, write_parts
from outletlens.sources.fixtures import SourceTables
from outletlens.sources.tables import FLAT_SCHEMA


class EmptySelection(Exception):
    """The selection returned no row (batch dataset creation refuses it)."""


def task_text(tasks: Sequence[Task]) -> str:
    """Names and parameters of the tasks, for the cache key."""
    return json.dumps([[t.task_name, vars(t)] for t in tasks], sort_keys=True, default=str)


def cache_folder(cache_root: str, params: Params, source: str = "", tasks: Sequence[Task] = TASKS,
                 inputs: str = "") -> str:
    key = params.query_id(json.dumps([source, inputs]) if inputs else source, task_text(tasks))
    return f"{cache_root.rstrip('/')}/query_id={key}"


def input_snapshot(spark: SparkSession, tables: SourceTables, params: Params) -> str:
    """Fingerprint of the files of both tables that the parameters' window reads."""
    days = (params.begin_day.isoformat(), params.end_day_exclusive.isoformat())
    return snapshot(spark, (tables.mentions, tables.events), days)


def published(spark: SparkSession, root: str) -> list[str]:
    """Names of the published results in ``root``, the served one last."""
    return [name.split(".", 1)[1] for name in fs_list(spark, f"{root}/_published") if "." in name]


def publish(spark: SparkSession, root: str, name: str) -> None:
    """Serve the result folder ``name``. The one served before stays for its readers; older ones go."""
    markers = [m for m in fs_list(spark, f"{root}/_published") if "." in m]
    number = int(markers[-1].split(".", 1)[0]) + 1 if markers else 1
    fs_touch(spark, f"{root}/_published/{number:012d}.{name}")
    for old in markers[:-1]:
        fs_delete(spark, f"{root}/_published/{old}")
        fs_delete(spark, f"{root}/{old.split('.', 1)[1]}")


def run_pipeline(spark: SparkSession, tables: SourceTables, params: Params, cache_root: str | None,
                 tasks: Sequence[Task] = TASKS, source: str = "",
                 refresh: bool = False) -> dict:
    """``{task: {part: DataFrame}}`` for ``params`` (or ``{"empty": True}``).
    ``source`` names the tables (both of them); what their files hold is found out. ``refresh=True``
    recomputes and publishes anew; the result served so far stays readable until the next
    refresh. Without a ``cache_root`` nothing is kept beyond the session's
    own tables: the parts are planned over the selection, written once."""
    if cache_root is None:
        flat = materialise(select_flat(tables, params))
        return {"empty": True} if flat.isEmpty() else run_dataset_pipeline(flat, tasks)
    root = cache_folder(cache_root, params, source, tasks, input_snapshot(spark, tables, params))
    served = [] if refresh else published(spark, root)
    if served:
        return read_parts(spark, f"{root}/{served[-1]}")
    name = f"run-{uuid.uuid4().hex}"
    fresh = f"{root}/{name}"
    try:
        with owned_tables(spark):
            flat = materialise_flat(spark, select_flat(tables, params), f"{fresh}/flat")
            if flat.isEmpty():
                fs_delete(spark, root)
                return {"empty": True}
            write_parts(run_dataset_pipeline(flat, tasks), fresh)
    except BaseException:
        fs_delete(spark, fresh)
        raise
    publish(spark, root, name)
    return read_parts(spark, fresh)


def materialise_flat(spark: SparkSession, flat: DataFrame, path: str) -> DataFrame:
    """Write the selection once and read it back: later tasks scan the copy."""
    flat.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def invalidate_cache(spark: SparkSession, cache_root: str, params: Params | None = None,
                     source: str = "", tasks: Sequence[Task] = TASKS, tables: SourceTables | None = None) -> None:
    """Drop one parameter set's cached results (over ``tables`` as they are now), or all of them."""
    if params is not None:
        inputs = "" if tables is None else input_snapshot(spark, tables, params)
        fs_delete(spark, cache_folder(cache_root, params, source, tasks, inputs))
        return
    for name in list_dirs(spark, cache_root):
        if name.startswith("query_id="):
            fs_delete(spark, f"{cache_root.rstrip('/')}/{name}")


def create_dataset(spark: SparkSession, tables: SourceTables, params: Params, name: str,
                   datasets_dir: str, results_dir: str, tasks: Sequence[Task] = TASKS,
                   fmt: str = "json") -> list[str]:
    """Batch dataset creation: select (once, as parquet), refuse an empty result, which leaves
    a saved dataset as it is, save the flat table as CSV (``datasets_dir/<name>.csv``) and write
    the tasks' parts (``results_dir/<name>/<task>/<part>``). Returns the parts' paths."""
    with owned_tables(spark):
        flat = materialise(select_flat(tables, params))
        if flat.isEmpty():
            raise EmptySelection(f"selection {params.id_text()} returned no row")
        write_flat_csv(flat, f"{datasets_dir.rstrip('/')}/{name}.csv")
        return write_parts(run_dataset_pipeline(flat, tasks), f"{results_dir.rstrip('/')}/{name}", fmt=fmt, ordered=True)


def run_saved_dataset(spark: SparkSession, path: str, tasks: Sequence[Task] = TASKS,
                      schema: StructType = FLAT_SCHEMA) -> dict[str, dict[str, DataFrame]]:
    """The tasks over one saved flat file (read once into a parquet copy)."""
    return run_dataset_pipeline(materialise(read_flat_csv(spark, path, schema)), tasks)
