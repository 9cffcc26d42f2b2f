"""Sinks, sources, cache and the streaming re-run."""

import datetime as dt
import json
import os
import shutil
import tempfile

import pandas as pd
import pytest
from pyspark.sql import types as T

import __spark_entry__ as E
from compare import rows_of_spark
from paths import SF001
from outletlens.operators import graph, selection
from outletlens.params import Params
from outletlens.operators.prepare import prepare
from outletlens.plans.batch import run_all_datasets
from outletlens.plans.pipeline import (EmptySelection, cache_folder, create_dataset, input_snapshot, invalidate_cache,
                                       publish, published, run_pipeline)
from outletlens.plans.tasks import GraphTask
from outletlens.session import fs_exists, materialise
from outletlens.sources.files import (read_dataset_dir, read_flat_csv, write_flat_csv,
                                      write_json, write_parts)
from outletlens.sources.fixtures import fx1_tables
from outletlens.sources.tables import FLAT_SCHEMA
from outletlens.streaming import rerun_on_new_datasets

P = E.P1.with_(minimum_distinct_source_count=3)


@pytest.fixture()
def tmp():
    return tempfile.mkdtemp(prefix="outletlens-test-")


def test_csv_roundtrip_with_extra_column(spark, tmp):
    schema = T.StructType(FLAT_SCHEMA.fields + [T.StructField("eventFoo", T.StringType())])
    flat = selection.select_flat(fx1_tables(spark, SF001), P).selectExpr("*", "'foo' AS eventFoo")
    write_flat_csv(flat, f"{tmp}/x.csv")
    back = read_flat_csv(spark, f"{tmp}/x.csv", schema)
    assert rows_of_spark(back) == rows_of_spark(flat)


def test_dataset_names_from_plain_files_and_spark_folders(spark, tmp):
    flat = selection.select_flat(fx1_tables(spark, SF001), P)
    write_flat_csv(flat, f"{tmp}/alpha.csv")                      # Spark folder
    flat.limit(3).toPandas().to_csv(f"{tmp}/beta.v2.csv", index=False)   # one plain file
    names = {r[0]: r[1] for r in read_dataset_dir(spark, tmp).groupBy("dataset").count().collect()}
    assert names == {"alpha": flat.count(), "beta": 3}


def test_json_sink_formats_timestamps_and_keeps_nulls(spark, tmp):
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 5, 6), None)],
                               "s string, t timestamp_ntz, n double")
    write_json(df, f"{tmp}/j")
    lines = [line for f in os.listdir(f"{tmp}/j") if f.endswith(".json")
             for line in open(f"{tmp}/j/{f}") if line.strip()]
    assert [json.loads(line) for line in lines] == [{"s": "a", "t": "2024-01-05T06:00:00Z", "n": None}]


def served(spark, tables, root, source="fx1", params=P, tasks=None):
    kw = {} if tasks is None else {"tasks": tasks}
    folder = cache_folder(root, params, source, inputs=input_snapshot(spark, tables, params), **kw)
    return folder, published(spark, folder)


def test_cache_hit_refresh_and_invalidation(spark, tmp):
    tables = fx1_tables(spark, SF001)
    first = run_pipeline(spark, tables, P, tmp, source="fx1")
    root, names = served(spark, tables, tmp)
    assert len(names) == 1
    assert set(first) == {"graph", "stackedGraph"}
    assert set(first["graph"]) >= {"edges", "edge_events", "nodes", "totals"}
    drill = rows_of_spark(first["stackedGraph"]["drilldown"])
    hit = run_pipeline(spark, tables, P, tmp, source="fx1")
    assert rows_of_spark(hit["graph"]["edges"]) == rows_of_spark(first["graph"]["edges"])
    # a refresh publishes a folder of its own; who reads the one before may go on
    again = run_pipeline(spark, tables, P, tmp, source="fx1", refresh=True)
    assert rows_of_spark(again["stackedGraph"]["drilldown"]) == drill == rows_of_spark(first["stackedGraph"]["drilldown"])
    assert len(served(spark, tables, tmp)[1]) == 2
    run_pipeline(spark, tables, P, tmp, source="fx1", refresh=True)
    now = served(spark, tables, tmp)[1]
    assert len(now) == 2 and names[0] not in now  # the oldest is gone
    assert sorted(n for n in os.listdir(root) if n.startswith("run-")) == sorted(now)
    invalidate_cache(spark, tmp, P, "fx1", tables=tables)
    assert not fs_exists(spark, root)
    run_pipeline(spark, tables, P, tmp, source="fx1")
    invalidate_cache(spark, tmp)
    assert not fs_exists(spark, root)


class Broken(GraphTask):
    """Fails while its parts are written, if its flag file is there."""

    def __init__(self, flag):
        super().__init__()
        self.flag = flag

    def run(self, prepared):
        from pyspark.sql import functions as F

        parts = super().run(prepared)
        if os.path.exists(self.flag):
            parts["nodes"] = parts["nodes"].withColumn("avgTone", F.raise_error(F.lit("lost")).cast("double"))
        return parts


def test_a_failing_refresh_leaves_the_served_result(spark, tmp):
    tables, tasks = fx1_tables(spark, SF001), (Broken(f"{tmp}/flag"),)
    first = run_pipeline(spark, tables, P, f"{tmp}/cache", tasks=tasks)
    nodes = rows_of_spark(first["graph"]["nodes"])
    root, names = served(spark, tables, f"{tmp}/cache", "", tasks=tasks)
    open(f"{tmp}/flag", "w").close()
    with pytest.raises(Exception, match="lost"):
        run_pipeline(spark, tables, P, f"{tmp}/cache", tasks=tasks, refresh=True)
    assert rows_of_spark(run_pipeline(spark, tables, P, f"{tmp}/cache", tasks=tasks)["graph"]["nodes"]) == nodes
    assert [n for n in os.listdir(root) if n.startswith("run-")] == names  # nothing of the failed run
    # a run that died without a trace of its own is never served
    os.makedirs(f"{root}/run-dead/graph/nodes")
    assert served(spark, tables, f"{tmp}/cache", "", tasks=tasks)[1] == names


def test_two_runs_that_race_serve_the_one_published_last(spark, tmp):
    for name in ("run-a", "run-b"):
        os.makedirs(f"{tmp}/{name}")
    os.makedirs(f"{tmp}/_published")
    for name in ("run-b", "run-a"):  # both saw an empty folder and took number 1
        open(f"{tmp}/_published/{1:012d}.{name}", "w").close()
    assert published(spark, tmp)[-1] == "run-b"
    publish(spark, tmp, "run-c")
    assert published(spark, tmp) == ["run-b", "run-c"]


def test_cache_sees_changed_and_appended_files_of_its_days(spark, tmp):
    from outletlens.sources.fixtures import SourceTables
    from outletlens.sources.tables import read_events, read_mentions, write_partitioned

    made = fx1_tables(spark, SF001)
    write_partitioned(made.mentions.coalesce(1), f"{tmp}/m")
    write_partitioned(made.events.coalesce(1), f"{tmp}/e")
    key = lambda: input_snapshot(spark, SourceTables(read_mentions(spark, f"{tmp}/m"), read_events(spark, f"{tmp}/e")), P)
    first = key()
    assert first == key() and first
    day = made.mentions.where(f"part_day = '{P.begin_day}'")
    write_partitioned(made.mentions.where("part_day = '2024-01-20'").coalesce(1), f"{tmp}/m", "append")  # outside the window
    assert key() == first
    write_partitioned(day.coalesce(1), f"{tmp}/m", "append")
    assert key() != first
    assert input_snapshot(spark, SourceTables(spark.range(1).toDF("a"), spark.range(1).toDF("a")), P) == ""


def test_empty_selection_is_flagged_and_not_cached(spark, tmp):
    tables = fx1_tables(spark, SF001)
    assert run_pipeline(spark, tables, Params(), tmp) == {"empty": True}
    assert not fs_exists(spark, cache_folder(tmp, Params()))
    create_dataset(spark, tables, P, "kept", f"{tmp}/datasets", f"{tmp}/results", tasks=(GraphTask(),))
    saved = read_flat_csv(spark, f"{tmp}/datasets/kept.csv").count()
    with pytest.raises(EmptySelection):
        create_dataset(spark, tables, Params(), "kept", f"{tmp}/datasets", f"{tmp}/results")
    assert read_flat_csv(spark, f"{tmp}/datasets/kept.csv").count() == saved > 0


def test_cache_key_holds_tasks_their_parameters_and_both_tables(spark, tmp):
    tables = fx1_tables(spark, SF001)
    few = run_pipeline(spark, tables, P, tmp, tasks=(GraphTask(n=5),), source="fx1")
    assert few["graph"]["nodes"].count() == 5
    whole = run_pipeline(spark, tables, P, tmp, source="fx1")
    assert set(whole) == {"graph", "stackedGraph"} and whole["graph"]["nodes"].count() > 5
    keys = {P.query_id(a, b) for a in ("m|e", '["m", "e"]') for b in ("", "x")}
    assert len(keys) == 4 and P.with_(filter_mention_id="a|b").query_id("c") != P.with_(filter_mention_id="a").query_id("b|c")
    assert set(run_pipeline(spark, tables, P, None)) == {"graph", "stackedGraph"}


NASTY = ['http://x/a"b,c', "  edge spaces ", "line\nbreak", "back\\slash\\", 'q""q', "é-ü"]


def test_pandas_written_csv_is_read_exactly(spark, tmp):
    flat = selection.select_flat(fx1_tables(spark, SF001), P).limit(len(NASTY)).toPandas()
    flat["mentionIdentifier"] = NASTY
    flat.to_csv(f"{tmp}/Case_20th_October_2018_->_21th.csv", index=False)
    flat.to_csv(f"{tmp}/with space+50%.CSV", index=False)
    flat.to_csv(f"{tmp}/zipped.csv.gz", index=False)
    got = read_dataset_dir(spark, tmp).toPandas()
    assert set(got.dataset) == {"Case_20th_October_2018_->_21th", "with space+50%", "zipped"}
    for _, part in got.groupby("dataset"):
        assert sorted(part.mentionIdentifier) == sorted(NASTY)
        assert part.mentionDocTone.notna().all()
    back = spark.createDataFrame(flat, FLAT_SCHEMA)
    write_flat_csv(back, f"{tmp}/again")
    assert rows_of_spark(read_flat_csv(spark, f"{tmp}/again")) == rows_of_spark(back)


def test_incremental_batch_reads_new_files_only(spark, tmp):
    from outletlens.plans.incremental import update_datasets

    tables = fx1_tables(spark, SF001)
    ds, st, out, full = (f"{tmp}/{x}" for x in ("ds", "state", "out", "full"))
    flat = materialise(selection.select_flat(tables, P))
    write_flat_csv(flat.where("mentionDateAdded % 2 = 0").coalesce(1), f"{ds}/a b+c.csv", mode="append")
    write_flat_csv(flat.coalesce(1), f"{ds}/still.csv")
    assert len(update_datasets(spark, ds, st, out)) == 2
    assert update_datasets(spark, ds, st, out) == []
    write_flat_csv(flat.where("mentionDateAdded % 2 = 1").coalesce(1), f"{ds}/a b+c.csv", mode="append")
    read = update_datasets(spark, ds, st, out)
    assert len(read) == 1 and "a b+c" in read[0]

    def same():
        run_all_datasets(spark, ds, full, fmt="parquet")
        for part in ("graph/edges", "graph/nodes", "stackedGraph/drilldown", "stackedGraph/streamgraph"):
            assert rows_of_spark(spark.read.parquet(f"{out}/{part}")) == rows_of_spark(spark.read.parquet(f"{full}/{part}")), part

    same()
    # a changed file: its dataset starts anew, the other one is not read
    flat.where("mentionDateAdded % 3 = 0").toPandas().to_csv(f"{ds}/still.csv/part-new.csv", index=False)
    for f in os.listdir(f"{ds}/still.csv"):
        if f.startswith("part-0"):
            os.remove(f"{ds}/still.csv/{f}")
    read = update_datasets(spark, ds, st, out)
    assert len(read) == 1 and "part-new" in read[0]
    same()
    # a run that stopped between two state tables: both files are read again, once
    part = [f for f in os.listdir(f"{st}/newest") if "a%20b" in f or "a b" in f]
    shutil.rmtree(f"{st}/newest/{part[0]}")
    assert len(update_datasets(spark, ds, st, out)) == 2
    same()


def test_document_of_no_edge_and_of_odd_names(spark, tmp):
    from frames import flat as flat_of
    from outletlens.sources.documents import read_graph_document, write_graph_document

    odd = ['a"b.com', "b\\c.com", "d\ne.com", "f/{}.com", " ", "ü.com"]
    rows = [dict(eventId=e, mentionSourceName=s, mentionIdentifier=None if e == 2 else f'{s}"/{{}},\n', mentionDocTone=None if e == 3 else float(e))
            for e in (1, 2, 3) for s in odd]
    for data in (rows, rows[:1]):
        parts = graph.graph(prepare(flat_of(spark, data)).mentions)
        write_graph_document(parts, f"{tmp}/doc")
        doc = json.loads("".join(open(f"{tmp}/doc/{f}").read() for f in sorted(os.listdir(f"{tmp}/doc")) if f.startswith("part")))
        edges = {(a, b): e for a, x in doc["edgesData"].items() for b, e in x.items()}
        assert {k: (e["eventsSharedCount"], e["meanToneDist"]) for k, e in edges.items()} == {
            (r.source1, r.source2): (r.eventsSharedCount, r.meanToneDist) for r in parts["edges"].collect()}
        assert sum(len(e["events"]) for e in edges.values()) == parts["edge_events"].count()
        assert set(doc["nodes"]) == {r.mentionSourceName for r in parts["nodes"].collect()}
        back = read_graph_document(spark, f"{tmp}/doc")
        for name in back:
            assert rows_of_spark(back[name]) == rows_of_spark(parts[name]), name


def test_parts_are_written_side_by_side(spark, tmp):
    import threading

    from outletlens.session import owned_tables, side_by_side

    both = threading.Barrier(2, timeout=60)
    assert side_by_side([lambda: both.wait() >= 0, lambda: both.wait() >= 0]) == [True, True]  # each waits for the other
    with owned_tables(spark):  # what threads write inside the block goes with it
        made = side_by_side([lambda: materialise(spark.range(3)), lambda: materialise(spark.range(4))])
        assert [m.count() for m in made] == [3, 4]
        paths = [m.inputFiles()[0] for m in made]
    assert not any(fs_exists(spark, p) for p in paths)
    with pytest.raises(ZeroDivisionError):
        side_by_side([lambda: 1 // 0, lambda: 1])


def test_dataset_names_below_a_root_with_a_space(spark, tmp):
    flat = selection.select_flat(fx1_tables(spark, SF001), P).limit(2)
    write_flat_csv(flat, f"{tmp}/my data/khashoggi.csv")
    assert {r[0] for r in read_dataset_dir(spark, f"{tmp}/my data").select("dataset").collect()} == {"khashoggi"}


def test_swapped_header_and_broken_rows_raise(spark, tmp):
    flat = selection.select_flat(fx1_tables(spark, SF001), P).limit(3).toPandas()
    names = list(flat.columns)
    flat[[names[1], names[0], *names[2:]]].to_csv(f"{tmp}/swapped.csv", index=False)
    with pytest.raises(Exception, match="(?i)header"):
        read_flat_csv(spark, f"{tmp}/swapped.csv").collect()
    flat.to_csv(f"{tmp}/broken.csv", index=False)
    with open(f"{tmp}/broken.csv", "a") as f:
        f.write("not,a,row\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_flat_csv(spark, f"{tmp}/broken.csv").collect()


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Europe/Berlin"])
def test_times_do_not_depend_on_the_session_zone(spark, zone):
    from pyspark.sql import functions as F

    from outletlens.functions import exprs as X

    times = [dt.datetime(2018, 3, 11, 2, 30), dt.datetime(2018, 11, 4, 1, 59, 59), dt.datetime(2018, 3, 25, 2, 15)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql("SELECT * FROM VALUES " + ", ".join(f"(timestamp_ntz'{t}')" for t in times) + " AS v(t)")
        got = df.select(X.floor_time("t").cast("string"), X.space_z_label("t"), X.iso_z_label("t"), X.ts_to_int_date("t"),
                        X.floor_time("t", "MONTH").cast("string"), F.col("t").cast("string")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [tuple(r)[:5] for r in got] == [
        (t.strftime("%Y-%m-%d %H:00:00"), t.strftime("%Y-%m-%d %H:%M:%SZ"), t.strftime("%Y-%m-%dT%H:%M:%SZ"),
         int(t.strftime("%Y%m%d%H%M%S")), t.strftime("%Y-%m-01 00:00:00")) for t in times]


@pytest.mark.parametrize("part,keys", [("nodes", lambda r: (-r.mentionnedEventsCount, r.mentionSourceName)),
                                       ("edges", lambda r: (r.source1, r.source2)),
                                       ("edge_events", lambda r: (r.source1, r.source2, r.eventId))])
def test_sink_order_of_parts(spark, tmp, part, keys):
    flat = selection.select_flat(fx1_tables(spark, SF001), P)
    parts = GraphTask().run(prepare(flat))
    write_parts({"graph": {part: parts[part]}}, tmp, ordered=True)
    files = sorted(f for f in os.listdir(f"{tmp}/graph/{part}") if f.endswith(".parquet"))
    rows = [r for f in files for r in spark.read.parquet(f"{tmp}/graph/{part}/{f}").collect()]
    assert rows and rows == sorted(rows, key=keys)


def test_create_dataset_then_batch_rerun(spark, tmp):
    tables = fx1_tables(spark, SF001)
    create_dataset(spark, tables, P, "p1", f"{tmp}/datasets", f"{tmp}/results", tasks=(GraphTask(),))
    res = run_all_datasets(spark, f"{tmp}/datasets", f"{tmp}/batch", tasks=(GraphTask(),), fmt="parquet")
    single = spark.read.json(f"{tmp}/results/p1/graph/edges")
    batch = spark.read.parquet(f"{tmp}/batch/graph/edges").where("dataset = 'p1'").drop("dataset")
    assert batch.count() == single.count() == res["graph"]["edges"].count()


def test_stream_reruns_only_new_datasets(spark, tmp):
    tables = fx1_tables(spark, SF001)
    ds, out, ck = f"{tmp}/datasets", f"{tmp}/results", f"{tmp}/ck"
    write_flat_csv(selection.select_flat(tables, P), f"{ds}/p1.csv")
    q = rerun_on_new_datasets(spark, ds, out, ck, tasks=(GraphTask(),))
    q.awaitTermination(120)
    edges = spark.read.parquet(f"{out}/graph/edges")
    n1 = edges.where("dataset = 'p1'").count()
    assert n1 > 0 and edges.select("dataset").distinct().count() == 1
    write_flat_csv(selection.select_flat(tables, E.P2.with_(minimum_distinct_source_count=3)),
                   f"{ds}/p2.csv")
    q = rerun_on_new_datasets(spark, ds, out, ck, tasks=(GraphTask(),))
    q.awaitTermination(120)
    edges = spark.read.parquet(f"{out}/graph/edges")
    assert {r[0] for r in edges.select("dataset").distinct().collect()} == {"p1", "p2"}
    assert edges.where("dataset = 'p1'").count() == n1


def test_cli_run_and_empty_cache(spark, tmp):
    from outletlens.__main__ import main
    from outletlens.sources.fixtures import stage

    stage(spark, "fx1", SF001, root=f"{tmp}/src")
    args = ["--mentions", f"{tmp}/src/mentions", "--events", f"{tmp}/src/events",
            "--begin", P.date_begin, "--end", P.date_end, "--min-sources", "3", "--confidence", "50"]
    assert main(["run", *args, "--cache", f"{tmp}/cache"]) == 0
    assert any(n.startswith("query_id=") for n in os.listdir(f"{tmp}/cache"))
    assert main(["empty-cache", "--cache", f"{tmp}/cache"]) == 0
    assert not any(n.startswith("query_id=") for n in os.listdir(f"{tmp}/cache"))


def test_presets():
    from outletlens.params import DATASET_PRESETS, preset
    assert len(DATASET_PRESETS) == 5
    p = preset("khashoggi_2018_10_20")
    assert (p.minimum_distinct_source_count, p.filter_mention_id) == (20, "khashoggi")
    assert p.end_day_exclusive.isoformat() == "2018-10-22"


def test_cli_create_dataset_and_rerun(spark, tmp):
    from outletlens.__main__ import main
    from outletlens.sources.fixtures import stage

    stage(spark, "fx1", SF001, root=f"{tmp}/src")
    args = ["--mentions", f"{tmp}/src/mentions", "--events", f"{tmp}/src/events",
            "--begin", P.date_begin, "--end", P.date_end, "--min-sources", "3", "--confidence", "50"]
    assert main(["create-dataset", *args, "--name", "p1", "--datasets", f"{tmp}/ds",
                 "--results", f"{tmp}/res"]) == 0
    assert os.path.isdir(f"{tmp}/res/p1/graph/edges")
    assert main(["rerun-datasets", "--datasets", f"{tmp}/ds", "--results", f"{tmp}/all",
                 "--format", "parquet"]) == 0
    edges = spark.read.parquet(f"{tmp}/all/graph/edges")
    assert edges.where("dataset = 'p1'").count() == spark.read.json(f"{tmp}/res/p1/graph/edges").count()


def test_ordered_sink_presents_nodes_by_count(spark, tmp):
    from outletlens.plans.tasks import run_dataset_pipeline
    from outletlens.sources.files import write_parts

    flat = selection.select_flat(fx1_tables(spark, SF001), P)
    res = run_dataset_pipeline(flat, (GraphTask(),))
    write_parts({"graph": {"nodes": res["graph"]["nodes"]}}, tmp, fmt="json", ordered=True)
    folder = f"{tmp}/graph/nodes"
    rows = [json.loads(line) for f in sorted(os.listdir(folder)) if f.endswith(".json")
            for line in open(f"{folder}/{f}") if line.strip()]          # part files in name order
    counts = [(-r["mentionnedEventsCount"], r["mentionSourceName"]) for r in rows]
    assert counts == sorted(counts) and len(counts) > 1
