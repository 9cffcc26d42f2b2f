"""Merkle manifest of a dataset, with proofs and versions by path copying.

The leaves of a tree (one per source, in id order) are numbered and cut into aligned blocks of
``arity ** levels`` leaves. A task takes one block, hashes its nodes up to the block's root, and
gives every leaf its siblings on the way. The roots of the blocks are the leaves of the next
round, until a tree has one node; the trees' roots are, in the order of the sources, the leaves
of one more tree.

The tree is persistent: a tampered leaf makes a version that shares all nodes off its path and
copies its ancestors only, first inside its block, then along the path that the upper rounds
found for the block's root. Nothing is larger than a block in any task: the upper paths travel
as one row per block.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outletlens.llm.common import ranked
from outletlens.session import materialise

ARITY, LEVELS = 3, 7  # blocks of 3 ** 7 leaves
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

STEP = "struct<left:string,right:string>"  # digests before and behind a node in its run, joined


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(col: Column) -> Column:
    """``-`` for a null, else the byte count, a colon and the value."""
    value = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(value), F.lit(":"), value), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    return F.sha2(F.concat(*(field(changed.get(c, F.col(c))) for c in FIELDS)), 256)


def block_levels(leaves: list[str], climb: int, arity: int) -> list[list[str]]:
    """The nodes of a block, level by level: its leaves first, ``climb`` levels above them."""
    levels = [leaves]
    for _ in range(climb):
        below = levels[-1]
        levels.append([digest("".join(below[i:i + arity])) for i in range(0, len(below), arity)])
    return levels


def steps(levels: list[list[str]], at: int, arity: int) -> list[dict]:
    """The siblings of leaf ``at`` in its run, and of its ancestors, below the block's root."""
    out = []
    for below in levels[:-1]:
        run = at - at % arity
        out.append({"left": "".join(below[run:at]), "right": "".join(below[at + 1:run + arity])})
        at //= arity
    return out


def copied_path(leaf: str, path: list[dict]) -> list[str]:
    """The nodes that a version with another ``leaf`` has of its own: the leaf and its ancestors."""
    out = [leaf]
    for step in path:
        out.append(digest(step["left"] + out[-1] + step["right"]))
    return out


def climb_of(nodes: Column, arity: int, levels: int) -> Column:
    """How many levels the blocks of a tree with so many nodes climb: until one node is left,
    at most ``levels``."""
    out = F.lit(levels)
    for k in reversed(range(levels)):
        out = F.when(nodes <= arity ** k, F.lit(k)).otherwise(out)
    return out


def in_blocks(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    return (nodes.withColumn("block", F.expr(f"pos div {arity ** levels}"))
            .withColumn("climb", climb_of(F.col("nodes"), arity, levels)))


def block_roots(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """The next round's nodes (tree, pos, nodes, digest), one per block."""
    def root(key, rows):
        import pyarrow as pa

        rows = rows.sort_by("pos")
        top = block_levels(rows["digest"].to_pylist(), rows["climb"][0].as_py(), arity)[-1]
        return pa.table({"tree": rows["tree"][:1], "pos": rows["block"][:1], "digest": top,
                         "nodes": pa.array([-(-rows["nodes"][0].as_py() // arity ** levels)], pa.int64())})

    return in_blocks(nodes, arity, levels).groupBy("tree", "block").applyInArrow(
        root, "tree long, pos long, digest string, nodes long")


def all_rounds(nodes: DataFrame, arity: int, levels: int) -> list[DataFrame]:
    """The nodes of every round (at least two, written but for the first); in the last one
    every tree is down to its root."""
    rounds = [nodes]
    while len(rounds) < 2 or not rounds[-1].filter("nodes > 1").isEmpty():
        rounds.append(materialise(block_roots(rounds[-1].select("tree", "pos", "digest", "nodes"), arity, levels)))
    return rounds


def with_paths(nodes: DataFrame, upper: DataFrame, arity: int, levels: int) -> DataFrame:
    """``nodes(tree, pos, nodes, digest, tampered, ...)`` with ``path`` and ``copied``, block by block. The path inside
    the block goes on with that of the block's root in ``upper(tree, pos, path, ...)``, whose other
    columns come along; so does the version of a tampered leaf with copies of the ancestors up there."""
    along = [c for c in upper.columns if c not in ("tree", "pos", "path")]

    def climb(key, rows, above):
        import numpy as np
        import pyarrow as pa

        rows = rows.sort_by("pos")
        head = above["path"][0].as_py()
        tree = block_levels(rows["digest"].to_pylist(), rows["climb"][0].as_py(), arity)
        path = [steps(tree, at, arity) + head for at in range(rows.num_rows)]
        copied = [None if leaf is None else copied_path(leaf, way) for leaf, way in zip(rows["tampered"].to_pylist(), path)]
        flat = pa.StructArray.from_arrays([pa.array([s[side] for way in path for s in way], pa.string()) for side in ("left", "right")],
                                          names=["left", "right"])
        ends = np.arange(len(path) + 1, dtype=np.int32) * len(path[0])
        out = rows.drop_columns(["block", "climb"])
        out = out.append_column("path", pa.ListArray.from_arrays(ends, flat))
        out = out.append_column("copied", pa.array(copied, pa.list_(pa.string())))
        for c in along:
            out = out.append_column(c, pa.array(above[c].to_pylist() * len(path), above.schema.field(c).type))
        return out

    schema = T.StructType([*nodes.schema.fields, *T.StructType.fromDDL(f"path array<{STEP}>, copied array<string>").fields,
                           *(upper.schema[c] for c in along)])
    return (in_blocks(nodes, arity, levels).groupBy("tree", "block")
            .cogroup(upper.withColumn("block", F.col("pos")).groupBy("tree", "block")).applyInArrow(climb, schema))


def upper_paths(rounds: list[DataFrame], top: DataFrame, arity: int, levels: int) -> DataFrame:
    """(tree, pos, path, ...) of the nodes of ``rounds[0]``, given those of ``rounds[-1]`` in ``top``."""
    for nodes in reversed(rounds[:-1]):
        plain = nodes.select("tree", "pos", "nodes", "digest", F.lit(None).cast("string").alias("tampered"))
        top = with_paths(plain, top, arity, levels).drop("nodes", "digest", "tampered", "copied")
    return top


def manifest(docs: DataFrame, tampered: Column, tampered_text: Column, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``source``, ``leaf``, ``subroot`` of its source, ``root``, ``path``
    (its siblings, level by level up to the root: those left and right of it, joined) and ``copied``
    (where ``tampered`` holds: the nodes of its own in the version in which its text is
    ``tampered_text``, from the leaf to the version's root; else null).

    A null field is hashed as ``-``. Leaves ascend by id, null ids first; rows that agree in source and
    id ascend by leaf, and repeated rows are equal leaves. A null source is a source, the first.
    Empty and long texts are leaves as any other. An empty table gives no row. Columns other than
    the five hashed ones are not read, whatever their names."""
    leaves = materialise(docs.select(
        "doc_id", "source", leaf_digest().alias("digest"),
        F.when(F.coalesce(tampered, F.lit(False)), leaf_digest(text=tampered_text)).alias("tampered")))
    places = materialise(ranked(leaves, "place", F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("digest")))
    sources = places.groupBy(F.col("source").alias("of")).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("nodes"))
    sources = materialise(ranked(sources, "tree", F.col("of").asc_nulls_first()))
    nodes = materialise(places.join(sources, F.col("source").eqNullSafe(F.col("of")))
                        .select("doc_id", "source", "tree", (F.col("place") - F.col("first")).alias("pos"), "nodes", "digest", "tampered"))
    rounds = all_rounds(nodes, arity, levels)
    # the subroots are the leaves of one more tree
    subroots = materialise(rounds[-1].select(F.lit(0).cast("long").alias("tree"), (F.col("tree") - 1).alias("pos"),
                                             F.lit(sources.count()).cast("long").alias("nodes"), "digest"))
    over = all_rounds(subroots, arity, levels)
    none = F.expr(f"cast(array() as array<{STEP}>)")
    root = upper_paths(over, over[-1].select("tree", "pos", none.alias("path"), F.col("digest").alias("root")), arity, levels)
    top = rounds[-1].join(root.select((F.col("pos") + 1).alias("tree"), "path", "root"), "tree").select(
        "tree", "pos", "path", F.col("digest").alias("subroot"), "root")
    upper = materialise(upper_paths(rounds[1:], top, arity, levels))
    return with_paths(nodes, upper, arity, levels).select(
        "doc_id", "source", F.col("digest").alias("leaf"), "subroot", "root", "path", "copied")


def proof(path: Column) -> Column:
    """Digest of the siblings of a path, level by level from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and its siblings make: hashed up the path, level by level."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def versions(tree: DataFrame) -> DataFrame:
    """The nodes that the versions in ``manifest`` copied: (doc_id, source, level, node), leaves at level 0."""
    return tree.select("doc_id", "source", F.posexplode("copied").alias("level", "node"))
