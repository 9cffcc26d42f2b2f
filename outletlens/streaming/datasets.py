"""Re-run the registered tasks when new dataset files appear.

The reference regenerates every dataset's results by a sequential loop over the
saved CSV files. Here a Structured Streaming file source watches the datasets
folder; each micro-batch only says *which* datasets received files. For those
datasets the whole folder is re-read (a dataset written as several part files
may span micro-batches, so results never come from a partial batch), the keyed
batch plan recomputes their parts, and dynamic partition overwrite replaces
only their result partitions. The stream's checkpoint (processed files) lives in
the shared folder, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from outletlens.plans.batch import DATASET, run_all_datasets
from outletlens.plans.tasks import TASKS, Task
from outletlens.session import owned_tables, scratch_path
from outletlens.sources.files import CSV_READ, dataset_name, qualified
from outletlens.sources.tables import FLAT_SCHEMA


def rerun_on_new_datasets(spark: SparkSession, datasets_dir: str, results_dir: str,
                          checkpoint_location: str | None = None,
                          tasks: Sequence[Task] = TASKS, fmt: str = "parquet",
                          available_now: bool = True,
                          processing_time: str | None = None) -> StreamingQuery:
    """Start the stream. ``available_now`` processes what is there and stops
    (a scheduled job); otherwise it runs with ``processing_time`` triggers."""
    if checkpoint_location is None:
        # one stream state per watched folder
        tag = hashlib.sha256(qualified(spark, datasets_dir).encode("utf-8")).hexdigest()[:16]
        checkpoint_location = scratch_path(spark, "streams", f"datasets-{tag}")
    files = (spark.readStream.schema(FLAT_SCHEMA).options(**CSV_READ)
             .option("recursiveFileLookup", True).csv(datasets_dir))
    arrived = files.select(dataset_name(spark, datasets_dir).alias(DATASET))

    def process(batch: DataFrame, epoch_id: int) -> None:
        touched = batch.select(DATASET).distinct()
        if touched.isEmpty():
            return
        with owned_tables(spark):
            run_all_datasets(spark, datasets_dir, results_dir, tasks=tasks, fmt=fmt, only=touched)

    writer = (arrived.writeStream.foreachBatch(process)
              .option("checkpointLocation", checkpoint_location))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
