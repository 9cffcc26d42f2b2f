"""The corpus pipeline, stage by stage, on the small tables."""

from collections import Counter

from brute import classes, text, words
from brute import SF001

import corpus_pipeline as P
from outletlens.llm import minhash_dedup, mixing
from outletlens.session import fs_list, materialise, owned_tables, scratch_path


def test_stages_keep_what_they_should(spark):
    docs, sizes = P.table(spark, SF001, "documents"), {}
    names = docs.columns
    quality = {r.doc_id: r.quality for r in P.table(spark, SF001, "labels").collect()}
    items = [" ".join(words(r.text)) for r in P.table(spark, SF001, "benchmark").collect()]
    for name, stage in P.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        docs = materialise(stage(spark, docs, SF001))
        after = [tuple(r) for r in docs.select("doc_id").collect()]
        sizes[name] = len(after)
        ids = {r[0] for r in after}
        if name != "sharding":
            assert docs.columns == names
        if name == "quality classifier":
            good = [k for k, _ in before if quality.get(k) == 1]
            assert sum(k in ids for k in good) >= 0.95 * len(good)
        if name == "MinHash near-dedup":
            assert sorted(r[0] for r in after) == sorted(set(classes(before)))
        if name == "benchmark decontamination":
            leaks = {k for k, t in before if any(x in " ".join(words(t)) for x in items)}
            assert not leaks & ids and len(ids) >= len(before) - len(leaks) - 2
        if name == "mixing sources to target weights":
            assert max(Counter(r[0] for r in after).values()) <= 3
        if name == "sharding":
            assert Counter(r[0] for r in after) == Counter(k for k, _ in before)
    assert list(sizes) == [n for n, _ in P.STAGES] and all(sizes.values())


def test_run_gives_the_shards_of_the_last_stage_and_leaves_nothing(spark):
    folder = scratch_path(spark, "pipeline")
    before = fs_list(spark, folder)
    with owned_tables(spark):
        out = P.run(spark, SF001)
        assert {"doc_id", "size", "shard", "slot"} <= set(out.columns) and out.count() > 0
        assert len(fs_list(spark, folder)) == len(before) + 1
    assert fs_list(spark, folder) == before


def test_of_rows_that_differ_elsewhere_the_least_is_taken(spark):
    rows = [(1, text(1), "b", 5), (1, text(1), "a", 9), (1, text(1), "a", 7), (2, text(1), "a", 0), (None, text(2), "z", 1), (None, text(2), "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, x int").repartition(3)
    kept = {(r.doc_id, r.source, r.x) for r in minhash_dedup.one_per_class(docs).collect()}
    assert kept == {(1, "a", 7), (None, "y", 2)}
    mixed = {(r.doc_id, r.source): r.x for r in mixing.mixed_rows(docs.filter("doc_id is not null")).collect()}
    assert mixed and all(x == {(1, "b"): 5, (1, "a"): 7, (2, "a"): 0}[k] for k, x in mixed.items())
