"""Near-duplicate lines by a segment-partition edit join, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outletlens.llm.common import components, materialise, scan_filters

COUNTED = "etainos0123"  # characters whose numbers are compared before lines are
FEW = 1 << 20  # keys of many lines that are broadcast, at most (16 bytes each)
KEY_BITS = 48  # of a key's hash; a key only proposes pairs, so a chance meeting costs one comparison


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(segment, gap, shift): where a line looks for the segments of lines up to ``edits`` shorter.

    Where the i-th of ``edits + 1`` segments is the first to match, at most i edits lie before it
    and the others after it, which bounds the shift on either side. Gap and shift 0 is the
    line's own segment, under which it is found itself."""
    return [(i, gap, shift) for i in range(edits + 1) for gap in range(edits + 1)
            for shift in range(max(-i, gap - (edits - i)), min(i, gap + edits - i) + 1)]


def segment_keys(lines: DataFrame, edits: int) -> DataFrame:
    """(rid, key): keys under which a line of ``lines(rid, line, n)`` meets all lines within so many edits and
    not longer: its own segments, and for every admissible length of the other line the substrings
    that can equal one of that line's. Segments are nearly equal, the last ones a character longer.
    One row per probe first and then one small expression for all of them: a row of all keys
    would be a method too large for the JVM's compiler. In a line of one-byte characters a substring is cut
    from its bytes, without counting characters; its hash is that of the same characters in any line."""
    parts = edits + 1
    each = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(gap).alias("gap"), F.lit(shift).alias("shift")) for i, gap, shift in probes(edits)))
    rows = lines.withColumn("raw", F.col("line").cast("binary")).withColumn("plain", F.octet_length("line") == F.col("n"))
    rows = rows.select("*", F.inline(each))
    rows = rows.withColumn("other", F.col("n") - F.col("gap")).filter(F.col("other") >= parts)
    rows = rows.withColumn("short", F.expr(f"cast(other div {parts} as int)"))
    # segments before the i-th that are a character longer, and whether it is one
    rows = rows.withColumn("ahead", F.col("i") - (F.lit(parts) - F.pmod("other", F.lit(parts))))
    rows = rows.withColumn("at", F.col("short") * F.col("i") + F.greatest("ahead", F.lit(0)) + 1 + F.col("shift"))
    rows = rows.withColumn("size", F.col("short") + F.when(F.col("ahead") >= 0, 1).otherwise(0))
    rows = rows.filter((F.col("at") >= 1) & (F.col("at") + F.col("size") - 1 <= F.col("n")))
    cut = lambda c: F.xxhash64(F.substr(c, F.col("at"), F.col("size")), "i", "other")
    key = F.when(F.col("plain"), cut("raw")).otherwise(cut("line"))
    return rows.select("rid", key.bitwiseAND(F.lit(-(1 << 64 - KEY_BITS))).alias("key"))


def line_links(lines: DataFrame, edits: int) -> DataFrame:
    """Components ``(id, component)`` of distinct ``lines(rid, line, n)``, n characters long, linked by
    at most ``edits`` edits.

    Nearly all keys belong to one line, so the first pass sends a key's least and largest line and
    their number only. A key of two lines is a pair by that. Keys of more lines are joined with
    the keys once more: their lines are compared with one of them each, which joins the copies
    of one line however many they are, and what is left of a key in several components is compared
    in full by a self join, whose condition holds the edit distance, so that only links come out of
    it; the numbers of some letters, which an edit changes by two in all, spare most distances.
    Up to ``FEW`` such keys, counted first, are broadcast to it; more are joined by a shuffle. Texts are
    fetched once, for lines that met another, a small part of all; they filter the scan by Spark's runtime filter."""
    spark = lines.sparkSession
    keys = segment_keys(lines, edits)
    keys = materialise(keys.groupBy("key").agg(F.min("rid").alias("lead"), F.max("rid").alias("last"), F.count(F.lit(1)).alias("m"))
                       .filter("lead < last"))
    many = keys.filter("m > 2").select("key", "lead")
    near_by = F.broadcast(many) if many.count() <= FEW else many
    met = materialise(segment_keys(lines, edits).join(near_by, "key").select("rid", "key", "lead"))
    pairs = materialise(keys.filter("m = 2").select("lead", F.col("last").alias("rid"))
                        .union(met.filter("rid <> lead").select("lead", "rid")).distinct())
    seen = materialise(pairs.select("rid").union(pairs.select("lead")).distinct())
    with scan_filters(spark):
        texts = materialise(lines.join(seen.filter("rid >= 0"), "rid", "left_semi").select("rid", "line", "n"))
    text = lambda name: texts.select(F.col("rid").alias(name), F.col("line").alias(f"t_{name}"))
    near = F.levenshtein("t_x", "t_y", edits).between(0, edits)
    star = materialise(pairs.select(F.col("lead").alias("x"), F.col("rid").alias("y")).join(text("y"), "y").join(text("x"), "x")
                       .filter(near).select(F.col("x").alias("a"), F.col("y").alias("b")))
    comp = components(star)

    one = (met.select("key", "rid").distinct().join(comp.withColumnRenamed("id", "rid"), "rid", "left")
           .withColumn("component", F.coalesce("component", "rid")))
    mixed = one.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    counts = [(F.col("n") - F.char_length(F.replace("line", F.lit(c)))).alias(f"has_{c}") for c in COUNTED]
    open_ = materialise(one.join(mixed, "key").join(texts, "rid").select("key", "rid", "component", "line", "n", *counts))
    side = lambda name: open_.select("key", F.col("rid").alias(name), F.col("component").alias(f"c_{name}"),
                                     F.col("line").alias(f"t_{name}"), *(F.col(c).alias(f"{c}_{name}") for c in ("n", *(f"has_{c}" for c in COUNTED))))
    other = lambda c: F.abs(F.col(f"{c}_x") - F.col(f"{c}_y"))
    rest = (side("x").join(side("y"), "key")
            .filter((F.col("x") < F.col("y")) & (F.col("c_x") != F.col("c_y")) & (other("n") <= edits)
                    & (reduce(add, (other(f"has_{c}") for c in COUNTED)) <= 2 * edits) & near)
            .select(F.col("x").alias("a"), F.col("y").alias("b")))
    return components(materialise(star.union(rest)))


def line_spots(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tkey, pos, line) of every line that is not blank."""
    return (docs.select(F.col(id_col).alias("doc_id"), row_text_key(text_col).alias("tkey"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
            .filter(F.col("line").rlike(r"\S")))


def row_text_key(text_col: str) -> Column:
    return F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0))


def repeated_lines(docs: DataFrame, edits: int = 2, min_chars: int = 25, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Lines that repeat an earlier line, exactly or up to ``edits`` edits.

    Lines are what newlines separate. Equal lines of any length are repeats of each other; lines of
    at least ``min_chars`` characters are also linked when their edit distance is at most ``edits``
    (in shorter ones two edits can change the sense). Of every component of links the first line
    in the order of ids, text keys, copies and line numbers stays. Blank lines always stay.

    One row per input row: ``doc_id, tkey, copy, n_lines, n_removed, removed`` (numbers from 0 of the lines
    that go, ascending). A null text has no lines, an empty one has one; a null id comes first in
    the order. Rows that agree in id and text, null ids included, are copies 1, 2, ... of a
    document: the first is answered as the others were not there, and all lines but the blank ones
    of the others go. Other columns are not read; an empty table gives no rows."""
    spots = line_spots(docs, id_col, text_col)
    lkey = F.unhex(F.md5("line"))
    lines = materialise(spots.groupBy("line").agg(F.count(F.lit(1)).alias("m"))
                        .select(F.monotonically_increasing_id().alias("rid"), "line", F.char_length("line").alias("n"), "m", lkey.alias("lkey")))
    comp = line_links(lines.filter(F.col("n") >= min_chars).select("rid", "line", "n"), edits).withColumnRenamed("id", "rid")
    known = materialise(lines.select("rid", "m", "lkey").join(comp, "rid", "left").filter("component is not null or m > 1")
                        .select("lkey", F.coalesce("component", "rid").alias("component")))
    place = F.struct("doc_id", "tkey", "pos")
    hits = materialise(spots.select("doc_id", "tkey", "pos", lkey.alias("lkey")).join(known, "lkey").select("doc_id", "tkey", "pos", "component"))
    # written, so that the join shuffles both sides itself and can split a component of many lines
    stays = materialise(hits.groupBy("component").agg(F.min(place).alias("stays")))
    gone = (hits.join(stays, "component").filter(~place.eqNullSafe(F.col("stays")))
            .groupBy(F.col("doc_id").alias("d2"), F.col("tkey").alias("t2")).agg(F.sort_array(F.collect_set("pos")).alias("removed")))
    rows = materialise(docs.select(F.col(id_col).alias("doc_id"), row_text_key(text_col).alias("tkey"),
                                   F.coalesce(F.char_length(text_col) - F.char_length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).alias("n_lines"))
                       .groupBy("doc_id", "tkey").agg(F.count(F.lit(1)).alias("copies"), F.max("n_lines").alias("n_lines")))
    again = rows.filter("copies > 1").select(F.col("doc_id").alias("d3"), F.col("tkey").alias("t3"))
    same = F.col("doc_id").eqNullSafe(F.col("d3")) & (F.col("tkey") == F.col("t3"))
    whole = (hits.join(again, same, "left_semi").groupBy(F.col("doc_id").alias("d3"), F.col("tkey").alias("t3"))
             .agg(F.sort_array(F.collect_set("pos")).alias("whole")))  # every line of a copied row is a hit
    none = F.array().cast("array<int>")
    out = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("tkey") == F.col("t2")), "left").join(whole, same, "left")
    out = out.select("doc_id", "tkey", "n_lines", "removed", "whole", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    removed = F.coalesce(F.when(F.col("copy") == 1, F.col("removed")).otherwise(F.col("whole")), none)
    return out.select("doc_id", "tkey", "copy", "n_lines", F.size(removed).alias("n_removed"), removed.alias("removed"))


def without_repeats(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with the repeated lines cut from their texts. Of rows that agree in id and text one (any)
    is the first copy; they may differ in other columns."""
    got = materialise(repeated_lines(docs, **params).filter("n_removed > 0")).select(
        F.struct("doc_id", "tkey").alias("__g"), F.least("copy", F.lit(2)).alias("__c"), F.col("removed").alias("__removed")).distinct()
    id_col, text_col = params.get("id_col", "doc_id"), params.get("text_col", "text")
    key = F.struct(F.col(id_col).alias("doc_id"), row_text_key(text_col).alias("tkey"))
    left = F.expr("array_join(filter(split(__text, '\\n'), (x, i) -> not array_contains(__removed, i)), '\\n')")
    rows = docs.withColumn("__k", key)
    copied = got.filter("__c = 2").select(F.col("__g").alias("__k")).distinct()  # their rows are numbered
    twice = materialise(rows.join(copied, "__k", "left_semi").withColumn("__n", F.monotonically_increasing_id()))
    first = twice.groupBy("__k").agg(F.min("__n").alias("__first"))
    twice = twice.join(first, "__k").withColumn("__c", F.when(F.col("__n") == F.col("__first"), 1).otherwise(2)).drop("__n", "__first")
    every = rows.join(copied, "__k", "left_anti").withColumn("__c", F.lit(1)).unionByName(twice)
    out = every.withColumn("__text", F.col(text_col)).join(
        got.withColumnRenamed("__c", "__d"), F.col("__k").eqNullSafe(F.col("__g")) & (F.col("__c") == F.col("__d")), "left")
    return out.withColumn(text_col, F.when(F.col("__removed").isNull(), F.col(text_col)).otherwise(left)).select(*docs.columns)
