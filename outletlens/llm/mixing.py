"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from outletlens.llm.common import WORD, materialise, range_sorted, ranked, root_of


def source_targets(sources: DataFrame, weights: tuple[int, ...], budget: int, max_epochs: int) -> DataFrame:
    """``sources(source, source_size)`` with ``target``: the budget shared by weight (the
    weights repeat over the sources in code-point order, null last), no target above
    ``max_epochs`` times its source, the excess shared again by weight.

    The common factor of the uncapped targets rises until no further source meets its
    cap; each round is one aggregate over the sources, whose number may be large."""
    order = F.col("source").asc_nulls_last()
    nth = F.array(*map(F.lit, weights))
    src = materialise(ranked(sources, "__rank", order)
                      .withColumn("weight", F.element_at(nth, (F.col("__rank") - 1).cast("int") % len(weights) + 1))
                      .withColumn("cap", F.col("source_size") * max_epochs).drop("__rank"))
    factor = 0.0
    while True:
        free = F.col("weight") * F.lit(factor) < F.col("cap")
        fixed, open_weight = src.agg(F.sum(F.when(~free, F.col("cap"))), F.sum(F.when(free, F.col("weight")))).first()
        if not open_weight:
            break
        risen = (budget - (fixed or 0)) / open_weight
        if risen <= factor:
            break
        factor = risen
    return src.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(factor))).drop(
        "weight", "cap")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, budget: int | None = None,
        seed: int = 9, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Words that a mix of the sources takes from every document.

    Each source's documents are shuffled by a hash of their ids and queued up to
    ``max_epochs`` times over; a copy's virtual finish time is the source's words up to and
    with it, over the source's target. All copies of all sources are sorted by that time,
    and the queue is cut where the budget (default: all words) is used up.

    One row per input row: ``doc_id, source, size`` (words), ``source_size, target, copies,
    taken`` (copies x size). A null text has size 0 and is never taken; a null source is a
    source of its own; repeated rows are queued one by one and are interchangeable; other
    columns are not read; an empty table gives no rows."""
    rows = materialise(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0)).alias("tkey"),
        F.xxhash64(F.col(id_col), F.lit(seed)).alias("h")))
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    budget = total if budget is None else budget
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, max_epochs)

    # words of the source up to each document in shuffled order: hash ranges, each
    # summed by itself, each starting where those before it end
    bits = max(1, root_of(n).bit_length())
    rows = rows.withColumn("b", F.shiftright("h", 64 - bits))
    before = W.partitionBy("source").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    starts = (rows.groupBy("source", "b").agg(F.sum("size").alias("words"))
              .select(F.col("source").alias("s2"), F.col("b").alias("b2"),
                      F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start")))
    upto = W.partitionBy("source", "b").orderBy("h", "doc_id", "tkey", "size").rowsBetween(W.unboundedPreceding, 0)
    queue = (rows.withColumn("upto", F.sum("size").over(upto))
             .join(starts, F.col("source").eqNullSafe(F.col("s2")) & (F.col("b") == F.col("b2")))
             .withColumn("upto", F.col("upto") + F.col("start")).drop("s2", "b2", "start", "b", "h"))
    t = targets.select(F.col("source").alias("s3"), "source_size", "target")
    queue = materialise(queue.join(t, F.col("source").eqNullSafe(F.col("s3"))).drop("s3"))

    finish = lambda e: (F.col("source_size") * e + F.col("upto")) / F.col("target")
    copies = (queue.filter("size > 0 and target > 0")
              .select("source", "size", F.explode(F.array(*[finish(e) for e in range(max_epochs)])).alias("finish")))
    order = [F.col("finish"), F.col("source").asc_nulls_last()]
    line = range_sorted(copies, *order)
    room, at = budget, None  # the partition of the line in which the budget ends
    for pid, words in sorted(map(tuple, line.groupBy("pid").agg(F.sum("size")).collect())):
        if words > room:
            at = pid
            break
        room -= words
    taken = F.lit(max_epochs)
    if at is not None:
        upto = W.partitionBy("pid").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        # the first copy that no longer fits
        cut = (line.filter(F.col("pid") == at).withColumn("used", F.sum("size").over(upto))
               .filter(F.col("used") > room).orderBy(*order).first())
        same = F.when(F.lit(cut["source"] is None), F.col("source").isNotNull()).otherwise(
            F.coalesce(F.col("source") < F.lit(cut["source"]), F.lit(False)))
        fits = lambda e: (finish(e) < cut["finish"]) | ((finish(e) == cut["finish"]) & same)
        taken = sum((fits(e).cast("int") for e in range(max_epochs)), F.lit(0))
    return queue.select("doc_id", "source", "tkey", "size", "source_size", "target",
                        F.when((F.col("size") > 0) & (F.col("target") > 0), taken).otherwise(0).alias("copies")
                        ).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_rows(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` as the mix takes them, each as often as it is taken. Rows that agree in id, source and text
    but not in other columns come out as the least of them, in the order of the columns."""
    key = [F.col("doc_id"), F.col("source"), F.coalesce(F.xxhash64("text"), F.lit(0))]
    got = (mix(docs, **params).filter("copies > 0").groupBy("doc_id", "source", "tkey")
           .agg(F.sum("copies").alias("__n"))
           .select(F.struct("doc_id", "source", "tkey").alias("__k"), "__n"))
    # rows that agree in id, source and text are one entry here, taken as often as all of them
    once = docs.select(F.struct(key[0].alias("doc_id"), key[1].alias("source"), key[2].alias("tkey")).alias("__q"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).groupBy("__q").agg(F.min("row").alias("row"))
    return (once.join(got, F.col("__q").eqNullSafe(F.col("__k")))
            .withColumn("__copy", F.explode(F.expr("sequence(1, cast(__n as int))"))).select("row.*"))
