"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import contextvars
import tempfile
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every plan in this package assumes: naive timestamps meaning UTC,
# AQE on (runtime broadcast of small sides, partition coalescing, skew split).
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.scheduler.mode": "FAIR",  # parts are written as small jobs side by side
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # a join too large to broadcast filters the larger side's scan by a Bloom filter of the smaller
    # side's keys, up to this size of it (Spark's default: 10 MB, where it would broadcast anyway)
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "512m",
    # checkpoint files of intermediate results are removed once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "outletlens", extra: dict | None = None) -> SparkSession:
    """Session for tests and the bench; on a cluster pass the cluster master and a
    shuffle partition count sized to the data (about 128-256 MB per partition)."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(SESSION_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared folder (HDFS, object store) and is
    used as is. Only when it is unset (tests, a bare local session) a scratch
    folder is created and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="outletlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path below the shared checkpoint folder (never a machine-local temp dir
    when the cluster names one)."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([root, "outletlens", *parts])


def fs_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system of ``path``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def fs_delete(spark: SparkSession, path: str) -> bool:
    """Recursive delete through the Hadoop file system of ``path``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.delete(p, True))


def fs_list(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in ``path``, sorted; empty if there is no such folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def fs_touch(spark: SparkSession, path: str) -> None:
    """Create an empty marker file through the Hadoop file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.create(p, True).close()


def materialise(df, spark: SparkSession | None = None, how: str = "table"):
    """Compute ``df`` once and cut its lineage, for intermediates read by several
    parts. ``how="table"`` writes a parquet table below the shared
    ``spark.checkpoint.dir`` and reads it back (consumers then get column
    pruning and pushed filters); ``how="checkpoint"`` uses a reliable
    ``checkpoint()`` in the same folder. Both survive executor loss; local
    checkpoints are never used."""
    import uuid

    spark = spark or df.sparkSession
    if how == "checkpoint":
        ensure_checkpoint_dir(spark)
        return df.checkpoint(eager=True)
    path = scratch_path(spark, "materialised", spark.sparkContext.applicationId, uuid.uuid4().hex)
    own(path)
    df.write.parquet(path)
    return spark.read.parquet(path)


# tables of the innermost block; each thread has its own, and ``side_by_side`` hands it on
_OWNED: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("owned", default=None)


def own(path: str) -> None:
    """Have ``path`` removed with the tables of the block it is written in, if there is one."""
    if (owned := _OWNED.get()) is not None:
        owned.append(path)


@contextmanager
def owned_tables(spark: SparkSession):
    """Tables that ``materialise`` writes inside the block are removed at its end: for jobs
    that have written their results by then."""
    paths: list[str] = []
    token = _OWNED.set(paths)
    try:
        yield
    finally:
        _OWNED.reset(token)
        for path in paths:
            fs_delete(spark, path)


def side_by_side(calls: Sequence[Callable[[], object]], workers: int = 4, pool: str = "parts") -> list:
    """Results of ``calls``, each of which runs Spark jobs of its own, ``workers`` at a time: small
    independent jobs then share the executors instead of waiting for each other's last task.
    With ``spark.scheduler.mode=FAIR`` they are in one pool. The first error is raised when all
    calls have ended."""
    from pyspark import inheritable_thread_target

    spark = SparkSession.getActiveSession()

    def started(call):
        def run():
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
            return call()
        return inheritable_thread_target(spark)(run)

    if workers <= 1 or len(calls) <= 1 or spark is None:
        return [call() for call in calls]
    with ThreadPoolExecutor(min(workers, len(calls))) as threads:
        jobs = [threads.submit(contextvars.copy_context().run, started(call)) for call in calls]
    return [job.result() for job in jobs]


def clear_materialised(spark: SparkSession) -> None:
    """Delete the tables this application wrote with ``materialise`` (call when
    the DataFrames built on them are no longer used, e.g. at the end of a job;
    other applications' tables are left alone)."""
    fs_delete(spark, scratch_path(spark, "materialised", spark.sparkContext.applicationId))
