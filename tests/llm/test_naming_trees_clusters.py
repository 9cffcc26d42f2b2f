"""Exact dedup, the Merkle manifest and centroid clustering against brute force, on odd rows,
with forced hash collisions, small blocks and shallow trees."""

import hashlib
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from outletlens.llm import exact_dedup, merkle_manifest, pivot_clusters, queries

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# 11
def groups(rows):
    by = defaultdict(list)
    for key, text in rows:
        by[(text or "").translate(LOWER)].append(key)
    return {t: (max((k for k in ids if k is not None), default=None), len(ids)) for t, ids in by.items()}


@pytest.mark.parametrize("block, bits", [(4096, 64), (16, 64), (5, 3), (1, 2)])
def test_exact_groups_whatever_block_and_hash(spark, block, bits):
    rnd = np.random.default_rng(block)
    rows = [(i, "".join(rnd.choice(list("aAbBé \n"), rnd.integers(0, 40)))) for i in range(60)]
    rows += [(100 + i, t.swapcase() if i % 2 else t) for i, (_, t) in enumerate(rows[:20])]
    rows += [(200, None), (201, ""), (None, "ab"), (None, "AB"), (202, "É"), (203, "é"), (7, rows[7][1]), (204, "a" * 40), (205, "a" * 41)]
    want = groups(rows)
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block=block, bits=bits).collect()
    expect = Counter((k, *want[t.translate(LOWER)], sha(t.translate(LOWER))) for k, t in ((k, t or "") for k, t in rows))
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expect
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(want)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert len({(r.level, r.name) for r in got}) == len(want)
    assert len({(r.level, r.name, r.text_sha256) for r in got}) == len(want)


def test_exact_groups_of_odd_rows(spark, odd, odd_rows, none):
    want = groups(odd_rows)
    got = exact_dedup.exact_groups(odd, block=64).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == Counter((k, *want[(t or "").translate(LOWER)]) for k, t in odd_rows)
    kept = exact_dedup.distinct_rows(odd)
    assert kept.columns == odd.columns
    assert Counter((r.doc_id, (r.text or "").translate(LOWER)) for r in kept.collect()) == Counter((k, t) for t, (k, _) in want.items())
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.distinct_rows(none).count() == 0


# 12
def leaf(row, text):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (*row[:4], text)))


def climb(nodes, arity):
    """Levels of a tree."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + arity])) for i in range(0, len(out[-1]), arity)])
    return out


def siblings(levels, at, arity):
    out = []
    for below in levels[:-1]:
        run = at - at % arity
        out.append(("".join(below[run:at]), "".join(below[at + 1:run + arity])))
        at //= arity
    return out


def trees(rows, changed, arity):
    """(id, leaf, subroot, root, siblings, copies or None) of every row."""
    of = defaultdict(list)
    for row in rows:
        of[row[1]].append(row)
    names = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        of[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    made = {s: climb([leaf(r, r[4]) for r in of[s]], arity) for s in names}
    over = climb([made[s][-1][0] for s in names], arity)
    out = []
    for i, s in enumerate(names):
        for at, row in enumerate(of[s]):
            path = siblings(made[s], at, arity) + siblings(over, i, arity)
            copies = None
            if changed(row):
                copies = [leaf(row, None if row[4] is None else row[4].replace("\n", ""))]
                for le, ri in path:
                    copies.append(sha(le + copies[-1] + ri))
            out.append((row[0], made[s][0][at], made[s][-1][0], over[-1][0], tuple(path), copies and tuple(copies)))
    return out


def even(row):
    return row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0


def built(docs, arity, levels):
    cond = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0
    tree = merkle_manifest.manifest(docs, cond, F.replace("text", F.lit("\n"), F.lit("")), arity, levels)
    return tree, [(r.doc_id, r.leaf, r.subroot, r.root, tuple(map(tuple, r.path)), r.copied and tuple(r.copied)) for r in tree.collect()]


@pytest.mark.parametrize("n, arity, levels", [(1, 3, 7), (60, 3, 1), (60, 3, 2), (40, 2, 2), (60, 3, 7)])
def test_manifest_against_plain_trees(spark, n, arity, levels):
    rows = [(i * 7 % n, "ab"[i % 2] if i % 3 else "hot", None if i % 5 == 0 else "en", i, f"t{i}\n{i}" if i % 4 else "flat") for i in range(n)]
    rows += [rows[0]] * 2 if n > 1 else []
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    tree, got = built(docs, arity, levels)
    assert Counter(got) == Counter(trees(rows, even, arity))
    made = merkle_manifest.versions(tree).collect()
    assert len(made) == sum(len(x[5]) for x in got if x[5])
    for r in got:  # an untouched text folds to the root, a changed one does not
        same = r[5] is None or r[5][0] == r[1]
        assert (r[5] is None or r[5][-1] == r[3]) == same


def test_manifest_of_odd_rows(spark, odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    _, got = built(odd, 3, 1)
    assert Counter(got) == Counter(trees(rows, even, 3))
    assert built(none, 3, 7)[1] == []
    _, same = built(odd.withColumn("source", F.lit(None).cast("string")), 3, 7)
    assert Counter(same) == Counter(trees([(a, None, c, d, e) for a, _, c, d, e in rows], even, 3))


def test_every_leaf_is_folded_up_its_path(spark, tmp_path, monkeypatch):
    rows = [(i, "ab"[i % 2], "en", i, f"t{i}\n{i}" if i % 3 else f"flat {i}") for i in range(40)] + [(None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op12_merkle_versions(spark, str(tmp_path)).collect():
        assert r.verified == (r.folded_root == r.root) == (r.doc_id is None or not (even((r.doc_id,)) and r.doc_id % 3))
    made = merkle_manifest.manifest
    spoilt = F.transform("path", lambda s: F.struct(F.concat(s["left"], F.lit("0")).alias("left"), s["right"].alias("right")))
    monkeypatch.setattr(merkle_manifest, "manifest", lambda *a: made(*a).withColumn("path", spoilt))
    for r in queries.op12_merkle_versions(spark, str(tmp_path)).collect():  # proofs with a wrong sibling verify nothing
        assert (r.doc_id is not None and even((r.doc_id,))) or not r.verified


# 13
def clustered(rows, k, rounds, dims):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    kept = [(i, [max(-(1 << 27), min(1 << 27, x)) for x in v]) for i, v in kept]
    order = sorted(kept, key=lambda r: (r[0] is None, sha(f"1:{r[0]}"), r[1]))
    cents = [v for _, v in order[:k]]

    def near(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in cents]
        return min(range(len(d)), key=lambda c: (d[c], c)), min(d)

    for _ in range(rounds):
        of = defaultdict(list)
        for _, v in kept:
            of[near(v)[0]].append(v)
        cents = [[sum(x) // len(of[c]) for x in zip(*of[c])] if of[c] else cents[c] for c in range(len(cents))]
    at = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, c, d in at:
        inertia[c] += d
    return Counter((i, c, d, inertia[c], sum(inertia.values()), tuple(cents[c])) for i, c, d in at)


@pytest.mark.parametrize("k, pivots", [(4, 3), (4, 0), (50, 8)])
def test_clusters_against_all_distances(spark, k, pivots):
    rnd = np.random.default_rng(k)
    rows = [(i, (rnd.normal(size=6) + 3 * (i % 5)).astype(np.float32).tolist()) for i in range(120)]
    rows += [(None, rows[3][1]), (None, [0.0] * 6), (5, rows[9][1]), (5, rows[5][1]), (200, None), (201, []), (202, [1.0] * 5), (203, [1.0] * 7),
             (204, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (205, [float("nan")] + [0.0] * 5), (206, [float("-inf")] + [0.0] * 5),
             (207, [3e38] * 6), (208, [-0.001] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS cluster", "2 AS distance", "3 AS v").repartition(3)
    got = pivot_clusters.cluster_vectors(df, k=k, pivots=pivots, dims=6).collect()
    assert Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in got) == clustered(rows, k, 3, 6)
    assert pivot_clusters.cluster_vectors(df.limit(0), k=k, dims=6).count() == 0


def test_pivots_spare_distances():
    rnd = np.random.default_rng(0)
    v = np.concatenate([rnd.normal(size=(200, 8)) * 20 + 400 * i for i in range(16)]).astype(np.int64)
    cents = v[::200].copy()
    base = pivot_clusters.choose_pivots(v[::13], 4)
    table = np.stack([pivot_clusters.squares(v, p) for p in base], axis=1)
    cluster, best, exact = pivot_clusters.assign(v, table, base, cents)
    full = ((v[:, None, :] - cents[None]) ** 2).sum(-1)
    assert (cluster == full.argmin(1)).all() and (best == full.min(1)).all()
    assert exact < len(v) * len(cents) / 4
