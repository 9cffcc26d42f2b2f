"""Re-run of the registered tasks over every saved dataset, in one job.

The reference loops over the saved CSV files one at a time; here all files are
read in one scan with a ``dataset`` column and every operator carries it as a
leading key, so one plan computes every dataset's results together and the
parts are written partitioned by dataset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from outletlens.plans.tasks import TASKS, Task, run_dataset_pipeline
from outletlens.session import materialise
from outletlens.sources.files import read_dataset_dir, write_parts
from outletlens.sources.tables import FLAT_SCHEMA

DATASET = "dataset"


def run_all_datasets(spark: SparkSession, datasets_dir: str, results_dir: str | None = None,
                     tasks: Sequence[Task] = TASKS, fmt: str = "json",
                     only: DataFrame | None = None,
                     schema: StructType = FLAT_SCHEMA) -> dict[str, dict[str, DataFrame]]:
    """Plan (and, with ``results_dir``, write) every task part for every dataset.

    ``only``: a DataFrame with a ``dataset`` column restricting the run to those
    datasets (a semi-join, no list on the driver); their result partitions are
    then replaced by dynamic partition overwrite, the others are kept. ``schema``: the flat
    schema, extended where the files have further columns."""
    flat = read_dataset_dir(spark, datasets_dir, schema, name_col=DATASET)
    if only is not None:
        flat = flat.join(only.select(DATASET).distinct(), DATASET, "left_semi")
    # every part re-reads its input: parse the CSV files once
    flat = materialise(flat)
    results = run_dataset_pipeline(flat, tasks, keys=(DATASET,))
    if results_dir is not None:
        write_parts(results, results_dir, fmt=fmt, partition_by=(DATASET,),
                    mode="overwrite", dynamic=only is not None)
    return results
