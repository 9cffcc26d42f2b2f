"""Sharding by longest-processing-time scheduling: groups that must stay together,
largest first, each to the least-loaded shard."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outletlens.llm.common import materialise, numbered, text_key

MANTISSA_BITS = 10  # groups count as equally large when their sizes agree in so many leading bits


def place(loads: np.ndarray, size: float, n: int) -> np.ndarray:
    """How many of ``n`` items of one size each shard gets when every item goes to the
    least-loaded shard (ties: lowest shard). Adds them to ``loads``.

    The greedy choice takes the ``n`` smallest of ``load + j * size``; all values below
    a level are taken at once, the heap places the rest."""
    got = np.zeros(len(loads), np.int64)
    if n > 2 * len(loads):
        below = lambda level: np.maximum(0, np.ceil((level - loads) / size)).astype(np.int64)
        lo, hi = float(loads.min()), float(loads.max()) + size * n
        for _ in range(64):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if below(mid).sum() <= n else (lo, mid)
        got = below(lo)
    heap = [(load + g * size, i) for i, (load, g) in enumerate(zip(loads.tolist(), got.tolist(), strict=True))]
    heapq.heapify(heap)
    for _ in range(n - int(got.sum())):
        load, i = heap[0]
        got[i] += 1
        heapq.heapreplace(heap, (load + size, i))
    loads += got * size
    return got


def shard_groups(groups: DataFrame, n_shards: int) -> DataFrame:
    """``groups(gkey, gsize, gkeyed columns...)`` with a ``shard``.

    The driver sees only the histogram of size classes: sizes below 2^10 are classes of
    their own, larger ones share a class when their leading bits agree, which bounds the
    classes by 2^10 per doubling of the size (some 40,000 for any input) and their widths
    by a thousandth. Within a class, groups are numbered and dealt in runs."""
    top = F.floor(F.log2(F.greatest("gsize", F.lit(1)).cast("double"))).cast("int")
    shift = F.greatest(top - MANTISSA_BITS + 1, F.lit(0))
    unit = F.pow(F.lit(2.0), shift)
    groups = materialise(groups.withColumn("cls", (F.floor(F.col("gsize") / unit) * unit).cast("long")))
    hist = groups.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.sum("gsize").alias("b"))
    loads, plan, total = np.zeros(n_shards), [], 0
    for cls, n, b in sorted(map(tuple, hist.collect()), reverse=True):
        got = place(loads, max(b / n, 1e-9), n)
        at = np.flatnonzero(got)
        plan.append((cls, np.cumsum(got[at]).tolist(), at.tolist()))
        total += n
    spark = groups.sparkSession
    # at most one bound per group, and at most shards x classes: a few MB
    plan = F.broadcast(spark.createDataFrame(plan, "cls long, bounds array<long>, shards array<int>"))
    return (numbered(groups, ["cls"], ["gkey"], total, "i").join(plan, "cls")
            .withColumn("shard", F.expr("shards[size(filter(bounds, x -> x <= i))]"))
            .drop("cls", "i", "bounds", "shards"))


def shard_documents(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` with equal texts stay in one shard; shards come out nearly equal
    in bytes.

    One row per input row: ``doc_id, size`` (UTF-8 bytes of the text plus 16),
    ``text_crc32, law`` ('bytes'), ``shard, slot`` (0, 1, ... within the shard) and
    ``grown_shard`` (null: only a law by key has one). A null text has no bytes and counts
    as an empty one: crc32 0, in one group with all empty texts; null and repeated ids are ordinary rows; other
    columns are not read; an empty table gives no rows."""
    text = F.col(text_col)
    rows = materialise(docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).alias("text_crc32"),
        text_key(F.coalesce(text, F.lit(""))).alias("gkey")))
    groups = rows.groupBy("gkey").agg(F.sum("size").alias("gsize"))
    placed = rows.join(shard_groups(groups, n_shards).drop("gsize"), "gkey")
    out = numbered(placed, ["shard"], ["doc_id", "text_crc32", "size"], rows.count(), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                      F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
