"""Helpers for plans that run over one dataset or over many at once.

Every operator takes ``keys``: extra leading grouping columns (e.g.
``("dataset",)``). With no keys a plan covers one dataset; with keys every
groupBy, join and ranking is done per key, in the same job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outletlens.session import materialise

ROWS_A_TASK = 250_000  # rows of a chain of keyed joins and aggregates in one task


def first_non_null(col: str, order: Column) -> Column:
    """Value of ``col`` from the row with the smallest ``order`` among rows where
    ``col`` is not null; NULL when every row is null. Rows whose ordering value is
    NULL are ignored by ``min_by``, which is what drops the null values here.
    Deterministic refinement of pandas ``groupby().first()`` (first non-null per
    column in an order the reference leaves arbitrary)."""
    c = F.col(col)
    return F.min_by(c, F.when(c.isNotNull(), order))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
          rank_col: str | None = None) -> DataFrame:
    """The first ``k`` rows per key in ``order`` (which must be a total order for
    deterministic output).

    No keys: ``orderBy().limit(k)`` is planned as TakeOrderedAndProject, a
    per-partition top-k followed by a merge of at most partitions x k rows; the
    rank column is then numbered over those k rows only.
    With keys: ``row_number() <= k`` per key, which Spark plans with a
    WindowGroupLimit below the exchange, so at most k rows per key and map task
    are shuffled.
    """
    if keys:
        w = Window.partitionBy(*keys).orderBy(*order)
        name = rank_col or "_rank"
        out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
        return out if rank_col else out.drop(name)
    out = df.orderBy(*order).limit(k)
    if rank_col:
        # k rows at most: a single-partition window is bounded by k.
        out = out.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)))
    return out


def bounded_side(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A join side with at most a fixed number of rows per key: broadcast without keys; with
    keys their number is data, and Spark decides by the side's size."""
    return df if keys else F.broadcast(df)


def spread(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``df`` dealt by ``key`` over as many partitions as keep each near ``ROWS_A_TASK`` of ``rows`` rows, for one
    exchange that a chain of joins and aggregates by that key goes on from: AQE joins partitions up to
    64 MB of compressed shuffle, and every sort and hash table of the chain then holds their rows
    unpacked in one task. Sides to be joined take the same ``rows``. As long as a task a core is enough,
    which AQE sees to, ``df`` is left as it is."""
    spark = df.sparkSession
    if rows <= ROWS_A_TASK * spark.sparkContext.defaultParallelism:
        return df
    # not below Spark's own number, for which a later join would shuffle once more
    return df.repartition(max(-(-rows // ROWS_A_TASK), int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def running_total(df: DataFrame, amount: str, order: Sequence[Column], name: str) -> DataFrame:
    """``df``, written in global order, with ``name``: the sum of ``amount`` over all rows before a row.
    No task sees more than its range: totals per range are summed over the ranges (one row
    each), rows inside their own. Rows equal in ``order`` follow each other in any order."""
    ranges = materialise(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = (ranges.groupBy("_range").agg(F.sum(amount).alias("_sum"))
              .select("_range", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_start")))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (ranges.withColumn("_within", F.coalesce(F.sum(amount).over(within), F.lit(0)))
            .join(starts, "_range").withColumn(name, F.col("_start") + F.col("_within"))
            .drop("_range", "_within", "_start"))


def group_scalar_filter(df: DataFrame, per_key: DataFrame, keys: Sequence[str],
                        predicate: Callable[[Column], Column]) -> DataFrame:
    """Filter ``df`` with a predicate on one aggregate value per key.

    ``per_key`` holds the key columns and one value column. No keys: the value is
    a scalar subquery (one small job, then a literal in the filter; no join).
    With keys: a join with ``per_key``, one row per key.
    """
    value_col = [c for c in per_key.columns if c not in keys]
    if len(value_col) != 1:
        raise ValueError("per_key must hold the keys and exactly one value column")
    if not keys:
        return df.where(predicate(per_key.scalar()))
    v = value_col[0]
    tmp = f"__{v}"
    joined = df.join(per_key.withColumnRenamed(v, tmp), list(keys))
    return joined.where(predicate(F.col(tmp))).drop(tmp)
