"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from outletlens.llm import (decontamination, exact_dedup, licenses, line_dedup, merkle_manifest, minhash_dedup, mixing,
                            pivot_clusters, quality, secrets, sharding, substring_dedup, vector_dedup)
from outletlens.llm.common import table


def op1_pu_quality(spark, d):
    return quality.score_quality(table(spark, d, "documents"), table(spark, d, "labels"))


def op2_license_paragraphs(spark, d):
    return licenses.find_licenses(table(spark, d, "documents"))


def op3_super_kmers(spark, d):
    return substring_dedup.remove_repeats(table(spark, d, "documents"), keep_text=False)


def op4_lpt_shards(spark, d):
    return sharding.shard_documents(table(spark, d, "documents"))


def op9_fair_mix(spark, d):
    return mixing.mix(table(spark, d, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op5_forest_secrets(spark, d):
    return secrets.find_secrets(table(spark, d, "documents"))


def op6_edit_join_lines(spark, d):
    return line_dedup.repeated_lines(table(spark, d, "documents")).drop("tkey").withColumn(
        "removed", F.concat_ws(",", "removed"))


def op7_bag_minhash(spark, d):
    return minhash_dedup.near_duplicates(table(spark, d, "documents")).select("doc_id", "class_id", "kept")


def op8_itq_vectors(spark, d):
    return vector_dedup.link_vectors(table(spark, d, "embeddings"))


def op10_latent_leaks(spark, d):
    return decontamination.find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op11_block_names(spark, d):
    return exact_dedup.exact_groups(table(spark, d, "documents")).drop("level", "name")


def op12_merkle_versions(spark, d):
    docs = table(spark, d, "documents")
    even = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0
    tree = merkle_manifest.manifest(docs, even, F.replace("text", F.lit("\n"), F.lit("")))
    # a version's root is its leaf hashed up the path; the leaves without a version are hashed up here
    folded = F.coalesce(F.element_at("copied", -1), merkle_manifest.folded(F.col("leaf"), F.col("path")))
    return tree.select("doc_id", "leaf", "subroot", "root", merkle_manifest.proof(F.col("path")).alias("proof_sha256"),
                       folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))


def op13_pivot_clusters(spark, d):
    placed = pivot_clusters.cluster_vectors(table(spark, d, "embeddings"))
    return placed.withColumn("centroid_sha256", pivot_clusters.centroid_digest(F.col("centroid"))).drop("centroid")


QUERIES = {f.__name__: f for f in (
    op1_pu_quality, op2_license_paragraphs, op3_super_kmers, op4_lpt_shards, op5_forest_secrets, op6_edit_join_lines,
    op7_bag_minhash, op8_itq_vectors, op9_fair_mix, op10_latent_leaks, op11_block_names, op12_merkle_versions,
    op13_pivot_clusters)}


def _field(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen(CAST({name} AS VARCHAR)) || ':' || {name} END"


def _leaf(text: str = "text") -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _clusters_sql(k: int = 16, rounds: int = 3) -> str:
    """Rounds of assignment and update, written out."""
    out = [f"""kept AS (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM kept ORDER BY c LIMIT {k})"""]
    for i in range(rounds + 1):
        out.append(f"""d{i} AS (
  SELECT r, vec_id, kept.v, c, CAST(list_sum(list_transform(list_zip(kept.v, c{i}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
  FROM kept, c{i}),
a{i} AS (SELECT * FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if i < rounds:
            out.append(f"""s{i} AS (SELECT c, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM a{i}),
t{i} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM s{i} GROUP BY c, i),
m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM t{i} GROUP BY c),
c{i + 1} AS (SELECT c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c))""")
    return "WITH " + ",\n".join(out) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)"""


ORACLE_SQL: dict[str, str] = {
    "op3_super_kmers": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35),
win AS (SELECT r, p, array_to_string(w[p:p + 34], ' ') AS t FROM starts),
hit AS (SELECT r, p FROM win WHERE t IN (SELECT t FROM win GROUP BY t HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS i FROM hit),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (
  SELECT words.r, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n
  FROM words ANTI JOIN gone USING (r, i) GROUP BY words.r)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(kept.n, 0) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)""",
    "op8_itq_vectors": """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (
  SELECT r, vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (
  SELECT a.r AS x, b.r AS y, b.vec_id AS yid FROM u a JOIN u b ON a.r <> b.r AND a.n > 0 AND b.n > 0
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
walk(r, id) AS (
  SELECT r, vec_id FROM v
  UNION
  SELECT l.x, w.id FROM walk w JOIN l ON l.y = w.r),
least_id AS (SELECT r, min(id) AS component_id FROM walk GROUP BY r)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.x = v.r) AS n_links, m.component_id,
       v.vec_id = m.component_id AS kept
FROM v JOIN least_id m USING (r)""",
    "op11_block_names": """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)""",
    "op12_merkle_versions": f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS r, doc_id, source, {_leaf()} AS leaf, {_leaf("replace(text, chr(10), '')")} AS other FROM documents),
crc_steps(i, x, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL
  SELECT i, xor(x >> 1, 3988292384 * (x & 1)), k + 1 FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(x ORDER BY i) AS tab FROM crc_steps WHERE k = 8),
folds AS (
  SELECT r, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                            lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM leaves, crc_table),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n FROM leaves),
nodes(source, lvl, pos, n, digest) AS (
  SELECT source, 0, pos, n, leaf FROM placed
  UNION ALL
  SELECT source, lvl + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(digest, '' ORDER BY pos))
  FROM nodes WHERE n > 1 GROUP BY source, lvl, pos // 3),
sides AS (
  SELECT source, lvl, pos, n, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS le,
         coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS ri
  FROM nodes WINDOW w AS (PARTITION BY source, lvl, pos // 3 ORDER BY pos)),
subroots AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(lvl, pos, n, digest) AS (
  SELECT 0, pos, n, subroot FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY lvl, pos // 3),
over_sides AS (
  SELECT lvl, pos, n, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS le,
         coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS ri
  FROM tops WINDOW w AS (PARTITION BY lvl, pos // 3 ORDER BY pos)),
walk(r, source, lvl, pos, proof, node) AS (
  SELECT r, source, 0, pos, '', CASE WHEN crc % 2 = 0 THEN other ELSE leaf END FROM placed JOIN folds USING (r)
  UNION ALL
  SELECT w.r, w.source, w.lvl + 1, w.pos // 3, w.proof || le || ri, sha256(le || node || ri)
  FROM walk w JOIN sides s ON s.source IS NOT DISTINCT FROM w.source AND s.lvl = w.lvl AND s.pos = w.pos AND s.n > 1),
climbed AS (SELECT r, w.source, proof, node FROM walk w JOIN nodes s ON s.source IS NOT DISTINCT FROM w.source AND s.lvl = w.lvl AND s.n = 1),
on_top(r, lvl, pos, proof, node) AS (
  SELECT r, 0, s.pos, proof, node FROM climbed c JOIN subroots s ON s.source IS NOT DISTINCT FROM c.source
  UNION ALL
  SELECT w.r, w.lvl + 1, w.pos // 3, w.proof || le || ri, sha256(le || node || ri)
  FROM on_top w JOIN over_sides s ON s.lvl = w.lvl AND s.pos = w.pos AND s.n > 1),
root AS (SELECT lvl, digest AS root FROM tops WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(o.proof) AS proof_sha256, o.node AS folded_root, o.node = root AS verified
FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source JOIN on_top o USING (r) JOIN root ON o.lvl = root.lvl""",
    "op13_pivot_clusters": _clusters_sql(),
}
