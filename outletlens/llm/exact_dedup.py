"""Exact duplicates by deterministic block naming.

A normalised text is cut into blocks of a fixed number of bytes (the last one may be shorter;
an empty text is one empty block). The distinct blocks of the corpus are sorted, and the place
in that order is a block's name. Then adjacent names are paired, the distinct pairs (a last
name without a neighbour is paired with nothing) sorted and named by their places, and so on
until every text is down to one name. Texts with the same number of blocks take the same number
of levels, and a name stands for one sequence of blocks only, so (level, name) identifies a text
without collisions.

Blocks are shuffled once, to find the distinct ones; afterwards a 64-bit hash stands for a block.
Where two blocks share a hash, their bytes tell them apart again. Names are given to distinct
blocks and pairs only, and rows take them by a join, in which Spark splits a hot block.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from outletlens.llm.common import ranked
from outletlens.session import materialise

BLOCK = 4096  # bytes


@F.arrow_udf(T.StringType())
def ascii_lower(text: pa.Array) -> pa.Array:
    """A-Z as a-z, every other character as it is; a null text is empty."""
    return pc.ascii_lower(pc.fill_null(text, ""))


def blocks_of(content: Column, size: int) -> Column:
    """The blocks of a binary value."""
    last = F.greatest(F.ceil(F.octet_length(content) / size), F.lit(1)) - 1
    return F.transform(F.sequence(F.lit(0).cast("long"), last.cast("long")),
                       lambda i: F.substring(content, (i * size + 1).cast("int"), F.lit(size)))


def block_hash(block: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(block), 64 - bits)


def names_of(keys: DataFrame, *by: str) -> DataFrame:
    """Distinct ``keys`` with their place in sorted order as ``name``."""
    return ranked(keys, "name", *(F.col(c).asc_nulls_first() for c in by))


def block_table(docs: DataFrame, id_col: str, size: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """The blocks of all rows of ``docs(id_col, content)``, written once: (rid, doc_id, sha, i, n,
    h, j), the ``i``-th of ``n`` blocks being the ``j``-th with hash ``h``; and the distinct (h, j)."""
    parts = F.posexplode(blocks_of(F.col("content"), size)).alias("i", "block")
    distinct = docs.select(F.explode(blocks_of(F.col("content"), size)).alias("block")).select(
        block_hash(F.col("block"), bits).alias("h"), "block").distinct()
    per_hash = materialise(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("m")))
    shared = per_hash.filter("m > 1")
    rows = (docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), "content",
                        F.sha2("content", 256).alias("sha"))
            .select("rid", "doc_id", "sha", F.greatest(F.ceil(F.octet_length("content") / size), F.lit(1)).alias("n"), parts)
            .withColumn("h", block_hash(F.col("block"), bits)))
    if shared.isEmpty():
        rows = rows.withColumn("j", F.lit(1))
    else:  # their bytes give such blocks an order
        order = distinct.join(shared.select("h"), "h", "left_semi").withColumn(
            "j", F.row_number().over(W.partitionBy("h").orderBy("block")))
        rows = rows.join(materialise(order), ["h", "block"], "left").withColumn("j", F.coalesce("j", F.lit(1)))
    keys = per_hash.select("h", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("j"))
    return materialise(rows.select("rid", "doc_id", "sha", "i", F.col("n").cast("long"), "h", "j")), keys


def text_identities(docs: DataFrame, id_col: str = "doc_id", block: int = BLOCK, bits: int = 64) -> DataFrame:
    """(rid, doc_id, sha, level, name) of every row of ``docs(id_col, content)``: contents are
    identical exactly if (level, name) are. One round of small jobs a level, of which there are
    log2 of the longest text's blocks."""
    table, keys = block_table(docs, id_col, block, bits)
    seq = materialise(table.select("rid", "i", "n", "h", "j").join(names_of(keys, "h", "j"), ["h", "j"])
                      .select("rid", "i", "n", "name"))
    level, found = 0, None
    while True:
        done = seq.filter("n = 1").select("rid", F.lit(level).alias("level"), "name")
        found = done if found is None else found.unionByName(done)
        open_ = seq.filter("n > 1")
        if open_.isEmpty():
            return found.join(table.filter("i = 0").select("rid", "doc_id", "sha"), "rid")
        place = F.expr("i div 2")
        pairs = materialise(open_.groupBy("rid", place.alias("i"), F.expr("(n + 1) div 2").alias("n")).agg(
            F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(0)).alias("b")))  # 0 names nothing
        names = names_of(pairs.select("a", "b").distinct(), "a", "b")
        seq = materialise(pairs.join(names, ["a", "b"]).select("rid", "i", "n", "name"))
        level += 1


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK,
                 bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id`` (largest id among equal texts),
    ``group_size``, ``kept``, ``text_sha256`` of the normalised text, and the text's identity
    ``level``, ``name``.

    Texts are equal when they agree after lower-casing A-Z; a null text counts as empty. Of rows
    that agree in text and largest id, one stays (they give equal rows here). Null ids come below
    all others: a group that has no other keeps one of its rows and has a null ``keep_id``. An
    empty table gives no row. Other columns of ``docs`` are not read."""
    content = docs.select(F.col(id_col).alias("doc_id"), F.encode(ascii_lower(F.col(text_col)), "UTF-8").alias("content"))
    rows = materialise(text_identities(content, "doc_id", block, bits))
    # written, so that the join shuffles both sides itself and can split the rows of a large group
    last = materialise(rows.groupBy("level", "name").agg(F.count(F.lit(1)).alias("group_size"),
                                                         F.max(F.struct("doc_id", "rid")).alias("last")))
    return rows.join(last, ["level", "name"]).select(
        "doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("last.rid")).alias("kept"),
        F.col("sha").alias("text_sha256"), "level", "name")


def distinct_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns and whole texts: of each group the
    row with the largest id; of rows that agree in that id and in the text, the least row."""
    key = F.sha2(F.encode(ascii_lower(F.col(text_col)), "UTF-8"), 256)
    kept = exact_groups(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col(id_col).alias("__at"), key.alias("__key"))
    hits = rows.join(kept, (F.col("__key") == F.col("__sha")) & F.col("__at").eqNullSafe(F.col("__id")), "left_semi")
    return hits.groupBy("__key").agg(F.min("__row").alias("__row")).select("__row.*")
