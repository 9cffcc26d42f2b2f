"""Near-duplicate vectors: iterative quantisation codes, multi-index Hamming tables,
cosine on the original vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outletlens.llm.common import components, materialise


def fit_itq(x: np.ndarray, bits: int, rounds: int = 40, seed: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimensions x bits) whose signs are the code: principal
    directions, then the rotation that brings the projections nearest to +-1."""
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    _, axes = np.linalg.eigh((x - mean).T @ (x - mean))
    axes = axes[:, ::-1][:, :bits]
    v = (x - mean) @ axes
    rot, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(axes.shape[1], axes.shape[1])))
    for _ in range(rounds if len(x) else 0):
        u, _, w = np.linalg.svd(np.where(v @ rot >= 0, 1.0, -1.0).T @ v)
        rot = (u @ w).T
    return mean, axes @ rot


def table_shape(n: int, cosine: float, miss: float) -> tuple[int, int, int]:
    """Bits of a substring, number of tables and Hamming radius for ``n`` vectors. Substrings grow
    with log2 n, so that the vectors that share a key by chance stay few at any ``n``; there are as
    many tables as bring the chance that a pair at the threshold meets in none below ``miss``,
    a bit differing by the angle's share of a half turn; the radius is four deviations above the mean."""
    bits = max(16, math.ceil(math.log2(max(n, 2))))
    p = min(max(math.acos(min(max(cosine, -1.0), 1.0)) / math.pi, 1e-6), 0.5)
    meet = (1 - p) ** bits + bits * p * (1 - p) ** (bits - 1)
    tables = max(1, math.ceil(math.log(miss) / math.log1p(-meet)))
    whole = tables * bits
    return bits, tables, round(whole * p + 4 * math.sqrt(whole * p * (1 - p)))


def link_vectors(vectors: DataFrame, cosine: float = 0.95, miss: float = 0.06, fit_rows: int = 20_000,
                 id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Links of all pairs of vectors with at least the given cosine, and their components.

    Equal vectors are first folded into one with a count. The rotations are fitted on at most
    ``fit_rows`` of the distinct vectors (the lowest hashes), as many as the code has multiples of
    the dimensions (64 at most each); every vector is coded. The code is cut into substrings, one a
    table, whose length and number ``table_shape`` takes from the number of vectors (four of 16
    bits up to 65,536 vectors at 0.95); two codes meet when some substring differs
    in at most one bit, that is, when they agree in it with one bit masked out. A pair is taken
    up in the first table and mask where it meets, and only within the radius in all; then
    the cosine of the original vectors decides, in double precision. Hot keys are left to
    skew-splitting sort-merge joins; a pair is written once.

    One row per input row: ``vec_id, n_links`` (other rows linked directly, copies included),
    ``component_id`` (smallest id reachable), ``kept`` (id equals component_id). Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing. Vectors shorter
    than the longest count as padded with zeros. A row with a null id is linked like any other
    and yields to any id in its component. An empty table gives no rows."""
    v = F.col("vec")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    sound = F.coalesce(F.size(v) > 0, F.lit(False)) & F.coalesce(
        F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.withColumn("vec", F.when(sound & (norm > 0) & (norm < float("inf")), v))
    reps = materialise(rows.filter(v.isNotNull()).groupBy("vec").agg(F.count(F.lit(1)).alias("n"),
                                                                     F.min("vec_id").alias("least"))
                       .withColumn("norm", norm).withColumn("rid", F.monotonically_increasing_id()))
    dim, n = reps.agg(F.max(F.size("vec")), F.count(F.lit(1))).first()
    dim = dim or 1
    width, tables, radius = table_shape(n, cosine, miss)
    unit = F.transform("vec", lambda x: x / F.col("norm"))
    sample = reps.select("rid", unit.alias("u")).orderBy(F.xxhash64("rid")).limit(fit_rows)

    def padded(column) -> np.ndarray:
        out = np.zeros((len(column), dim))
        for i, x in enumerate(column):
            out[i, :len(x)] = x
        return out

    x, own = padded([r["u"] for r in sample.collect()]), min(dim, 64)
    fits = [fit_itq(x, own, seed=8 + i) for i in range(-(-width * tables // own))]
    mean, proj = fits[0][0], np.concatenate([axes for _, axes in fits], axis=1)[:, :width * tables]
    held = 64 // width  # substrings in a 64-bit word of the code
    words = [slice(lo * width, min(lo + held, tables) * width) for lo in range(0, tables, held)]

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            signs = (padded(b["u"]) - mean) @ proj >= 0
            packed = {f"code{w}": (signs[:, at] * (np.uint64(1) << np.arange(at.stop - at.start, dtype=np.uint64)))
                      .sum(axis=1, dtype=np.uint64).view(np.int64) for w, at in enumerate(words)}
            yield pd.DataFrame({"rid": b["rid"], **packed})

    names = [f"code{w}" for w in range(len(words))]
    codes = materialise(reps.select("rid", unit.alias("u")).mapInPandas(coded, "rid long, " + ", ".join(f"{c} long" for c in names)))
    # every bit position is one mask: its table keeps the other bits of its substring
    part = [(t // held, ((1 << width) - 1) << (t % held * width)) for t in range(tables)]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    masks = [(t, signed(1 << i), signed(whole & ~(1 << i))) for t, (_, whole) in enumerate(part) for i in range(64) if whole >> i & 1]
    keys = codes.select("rid", *names, F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.lit(bit).alias("bit"), F.col(names[part[t][0]]).bitwiseAND(F.lit(keep)).alias("key"))
        for t, bit, keep in masks])).alias("k")).select("rid", *names, "k.*")
    a, b = keys.alias("a"), keys.alias("b")
    diff = [F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}")) for c in names]
    within = [diff[w].bitwiseAND(F.lit(signed(whole))) for w, whole in part]
    lowest = {t: min((m for m in masks if m[0] == t), key=lambda m: m[1] % 2**64)[1] for t, _, _ in masks}
    first = F.lit(False)
    for t, d in enumerate(within):
        here = (d == F.col("a.bit")) | ((d == 0) & (F.col("a.bit") == lowest[t]))
        for w in within[:t]:  # in no earlier table
            here = here & (F.bit_count(w) > 1)
        first = first | ((F.col("a.t") == t) & here)
    pairs = (a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.bit") == F.col("b.bit"))
                    & (F.col("a.key") == F.col("b.key")) & (F.col("a.rid") < F.col("b.rid"))
                    & (sum((F.bit_count(d) for d in diff), F.lit(0)) <= radius) & first)
             .select(F.col("a.rid").alias("x"), F.col("b.rid").alias("y")))
    side = lambda name: reps.select(F.col("rid").alias(name), F.col("vec").alias(f"v{name}"),
                                    F.col("norm").alias(f"n{name}"), F.col("n").alias(f"c{name}"))
    dot = F.aggregate(F.zip_with("vx", "vy", lambda p, q: F.coalesce(p * q, F.lit(0.0))), F.lit(0.0), lambda s, z: s + z)
    links = materialise(pairs.join(side("x"), "x").join(side("y"), "y")
                        .filter(dot / (F.col("nx") * F.col("ny")) >= cosine).select("x", "y", "cx", "cy"))
    degree = (links.select(F.col("x").alias("rid"), F.col("cy").alias("c"))
              .union(links.select("y", "cx")).groupBy("rid").agg(F.sum("c").alias("others")))
    comp = components(links.select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("id", "rid")
    info = (reps.join(comp, "rid", "left").join(degree, "rid", "left")
            .withColumn("component", F.coalesce("component", "rid")))
    least = info.groupBy("component").agg(F.min("least").alias("component_id"))
    info = info.join(least, "component").select(
        F.col("vec").alias("v2"), "component_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    out = rows.join(info, rows["vec"] == info["v2"], "left")
    component_id = F.when(F.col("vec").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                      component_id.alias("component_id"), F.col("vec_id").eqNullSafe(component_id).alias("kept"))

