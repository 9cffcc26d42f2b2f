"""Helpers shared by the training-data operators: input tables, gapless numbering
without a single-task window, word hashing on Arrow buffers, connected components."""

from __future__ import annotations

import math
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from outletlens.session import materialise

# a word: a run of characters other than the six ASCII blanks
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> Column:
    """16 bytes that equal texts share (the empty key for a null text)."""
    return F.coalesce(F.unhex(F.md5(text)), F.lit(b""))


def hash_fold(doc_id: Column) -> Column:
    """The fold of a row: crc32 of its id as text, modulo 4."""
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(4))


def root_of(n: int) -> int:
    """Bucket count that keeps both the rows of a bucket and the number of buckets
    near the square root of the input, whatever its size."""
    return max(1, math.isqrt(max(n, 1)))


def numbered(df: DataFrame, group: list[str], by: list[str], rows: int, name: str) -> DataFrame:
    """Gapless numbers from 0 within each group, also where one group holds most rows:
    rows are numbered inside hash buckets of the group, and each bucket starts where
    the ones before it end. Rows equal in all of ``by`` are interchangeable."""
    d = df.withColumn("__b", F.pmod(F.xxhash64(*by), F.lit(root_of(rows))))
    at = [*group, "__b"]
    before = W.partitionBy(*group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    starts = (d.groupBy(*at).agg(F.count(F.lit(1)).alias("__n"))
              .select(*at, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")))
    d = d.withColumn("__i", F.row_number().over(W.partitionBy(*at).orderBy(*by)) - 1)
    return (d.join(starts, at).withColumn(name, F.col("__i") + F.col("__start"))
            .drop("__b", "__i", "__start"))


def range_sorted(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` in global order, written once: partition number ``pid`` follows the order,
    and the rows of a partition are to be ordered again by the reader."""
    return materialise(df.repartitionByRange(*order).withColumn("pid", F.spark_partition_id()))


def ranked(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Global numbers from 1 in the given order, without a single-task sort."""
    d = range_sorted(df, *order)
    before = W.orderBy("pid").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    starts = (d.groupBy("pid").agg(F.count(F.lit(1)).alias("__n"))
              .select("pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")))
    d = d.withColumn("__i", F.row_number().over(W.partitionBy("pid").orderBy(*order)))
    return d.join(starts, "pid").withColumn(name, F.col("__i") + F.col("__start")).drop(
        "pid", "__i", "__start")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (undirected; written, as it is read often):
    ``(id, component)`` with the smallest id reachable, for ids that have an edge. A round takes
    three hops over the edges, each the least label of a node and its neighbours, and one
    pointer jump, and is written to the shared folder, so that lineage stays short; rounds go
    on until nothing changes. Only the test for a change reaches the driver."""
    a, b = F.col("a"), F.col("b")
    near = edges.select(a, b).union(edges.select(b.alias("a"), a.alias("b"))).union(
        edges.select(a, a.alias("b"))).union(edges.select(b.alias("a"), b))

    def hop(label: DataFrame) -> DataFrame:
        return (near.join(label.select(F.col("id").alias("b"), "component"), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("component").alias("component")))

    label = near.groupBy(a.alias("id")).agg(F.min("b").alias("component"))
    while True:
        was = label
        new = hop(hop(label))
        up = new.select(F.col("id").alias("component"), F.col("component").alias("up"))
        new = new.join(up, "component").select("id", F.col("up").alias("component"))
        label = materialise(new)
        if not label.join(was.withColumnRenamed("component", "was"), "id").filter("component <> was").limit(1).count():
            return label


@contextmanager
def scan_filters(spark: SparkSession):
    """Inside the block, a join whose smaller side is not broadcast filters the larger side's scan by a
    Bloom filter of the smaller one's keys (Spark's runtime filter), at any size of the scan; Spark's own
    settings start it at 10 GB. The smaller side has to have a condition. For jobs that run in the block."""
    prefix = "spark.sql.optimizer.runtime.bloomFilter."
    settings = {f"{prefix}enabled": "true", f"{prefix}applicationSideScanSizeThreshold": "1m", f"{prefix}creationSideThreshold": "512m"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# --- words of Arrow text batches, hashed without a Python loop ---------------------

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64 (kept per worker, grown as needed)."""
    if len(_POWERS.get(base, ())) < n:
        p = np.full(1 << max(n - 1, 1).bit_length(), np.uint64(base), np.uint64)
        p[0] = 1
        _POWERS[base] = np.multiply.accumulate(p)
    return _POWERS[base]


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """splitmix64 finaliser: spreads 64-bit values evenly."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column (nulls as empty) and the text offsets."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None and len(off) > 1 else np.zeros(0, np.uint8)
    return raw, off - off[0]


def spans(raw: np.ndarray, off: np.ndarray, breaks: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every run between ``breaks``, and the index of the first
    run of each text (one more entry than texts)."""
    inside = ~breaks[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True  # a text ends its last run
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: differences of a running polynomial
    sum, brought to the same power by the inverse powers of the base."""
    out = np.empty(len(start), np.uint64)
    step = 1 << 17  # spans at a time, so that the running sums stay in cache
    for lo in range(0, len(start), step):
        s, e = start[lo:lo + step], end[lo:lo + step]
        a, z = int(s[0]), int(e[-1])
        run = np.zeros(z - a + 1, np.uint64)
        np.cumsum((raw[a:z].astype(np.uint64) + np.uint64(1)) * powers(_BASE, z - a)[:z - a], out=run[1:])
        out[lo:lo + step] = (run[e - a] - run[s - a]) * powers(pow(_BASE, -1, 2**64), z - a)[s - a]
    return mix64(out ^ (end - start).astype(np.uint64))
