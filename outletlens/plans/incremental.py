"""Results of saved datasets kept up to date from mergeable state, as their files arrive.

Re-reading a dataset's files whenever one of them is new costs its whole size each time. Here the
analyses' aggregates below the top lists are kept per dataset (``graph.outlet_state``: tone sums,
counts and first URLs; ``stacked.hour_state``: first mentions of an hour; the newest event's date).
Sums, counts and minima of parts merge into those of the whole, so a run reads only the files that it has
not seen, merges their state into the kept one, and computes the parts of the datasets touched
from the merged state.

Every state row's partition carries the fingerprint of the files it was built from. A dataset is
rebuilt from all its files when one of them changed or is gone, or when its state tables disagree
about the fingerprint (a run was interrupted between them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outletlens.operators import graph, stacked
from outletlens.operators.prepare import prepare
from outletlens.params import GRAPH_TOP_OUTLETS, STACKED_TIME_UNIT, STACKED_TOP_OUTLETS
from outletlens.plans.batch import DATASET
from outletlens.session import fs_exists, materialise, owned_tables
from outletlens.sources.files import CSV_READ, dataset_name, file_list, literal, name_below, write_parts
from outletlens.sources.tables import FLAT_SCHEMA

KEYS = (DATASET,)
FILES = "dataset string, path string, length long, changed long, fingerprint decimal(38,0)"
OUTLETS = ("eventId long, mentionSourceName string, toneSum double, toneCount long, "
           "first struct<mentionDateAdded: timestamp_ntz, mentionIdentifier: string>, fingerprint decimal(38,0), dataset string")
HOURS = ("eventId long, mentionSourceName string, roundedMentionDate timestamp_ntz, first struct<mentionDateAdded: timestamp_ntz, "
         "mentionIdentifier: string, mentionDocTone: double, positiveTone: boolean>, fingerprint decimal(38,0), dataset string")
NEWEST = "newest timestamp_ntz, fingerprint decimal(38,0), dataset string"
STATES = {"outlets": OUTLETS, "hours": HOURS, "newest": NEWEST, "files": FILES}


def kept_state(spark: SparkSession, state_dir: str) -> dict[str, DataFrame]:
    """The state tables, empty where there are none yet."""
    out = {}
    for name, schema in STATES.items():
        path = f"{state_dir.rstrip('/')}/{name}"
        known = T.StructType.fromDDL(schema)
        out[name] = spark.read.schema(known).parquet(path) if fs_exists(spark, path) else spark.createDataFrame([], known)
    return out


def arrivals(spark: SparkSession, datasets_dir: str, state: dict[str, DataFrame]) -> DataFrame:
    """(dataset, path, length, changed, fingerprint, rebuild, unseen): the files of every dataset that is to be
    updated, the fingerprint of all its files, whether it starts anew, and which files its state lacks."""
    fields = ["path", "length", "changed"]
    files = file_list(spark, [datasets_dir]).select(name_below(spark, datasets_dir, F.col("path")).alias(DATASET), *fields)
    each = F.xxhash64(*fields).cast("decimal(38,0)")
    total = F.sum(each).cast("decimal(38,0)").alias("fingerprint")
    known = state["files"].select(DATASET, *fields, F.lit(True).alias("_known"))
    both = files.withColumn("_there", F.lit(True)).join(known, [DATASET, *fields], "full_outer")
    # the fingerprint a dataset's tables should carry, against those that they do carry
    carried = None
    for name in STATES:
        one = state[name].groupBy(DATASET).agg(F.min("fingerprint").alias("_low"), F.max("fingerprint").alias("_high"))
        carried = one if carried is None else carried.unionByName(one)
    carried = carried.groupBy(DATASET).agg((F.count(F.lit(1)) == len(STATES)).alias("_all"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    seen = state["files"].groupBy(DATASET).agg(F.sum(F.xxhash64(*fields).cast("decimal(38,0)")).cast("decimal(38,0)").alias("_seen"))
    sound = carried.join(seen, DATASET).select(DATASET, (F.col("_all") & (F.col("_low") == F.col("_high")) & (F.col("_low") == F.col("_seen"))).alias("_sound"))
    lost = both.groupBy(DATASET).agg(F.max(F.col("_there").isNull()).alias("_lost"))
    now = files.groupBy(DATASET).agg(total)
    plan = (now.join(lost, DATASET).join(sound, DATASET, "left")
            .select(DATASET, "fingerprint", (F.col("_lost") | ~F.coalesce("_sound", F.lit(False))).alias("rebuild")))
    there = both.where("_there").select(DATASET, *fields, F.col("_known").isNull().alias("unseen"))
    todo = there.join(plan, DATASET)
    touched = todo.where("unseen or rebuild").select(DATASET).distinct()
    return todo.join(touched, DATASET, "left_semi")


def update_datasets(spark: SparkSession, datasets_dir: str, state_dir: str, results_dir: str, fmt: str = "parquet",
                    schema: T.StructType = FLAT_SCHEMA, n: int = GRAPH_TOP_OUTLETS, top: int = STACKED_TOP_OUTLETS,
                    unit: str = STACKED_TIME_UNIT) -> list[str]:
    """Bring state and results (graph and stacked series) up to date with the files of
    ``datasets_dir``; returns the names of the files read. Result partitions of other datasets stay;
    those of a dataset all of whose files are gone stay too."""
    with owned_tables(spark):
        state = kept_state(spark, state_dir)
        todo = materialise(arrivals(spark, datasets_dir, state))
        paths = [literal(r.path) for r in todo.where("unseen or rebuild").select("path").collect()]  # what the reader is to open
        if not paths:
            return []
        flat = spark.read.schema(schema).options(**CSV_READ).csv(paths)
        flat = materialise(flat.select(dataset_name(spark, datasets_dir).alias(DATASET), *schema.fieldNames()))
        new = prepare(flat, KEYS)
        marks = todo.select(DATASET, "fingerprint", "rebuild").distinct()
        going_on = marks.where("not rebuild").select(DATASET)

        def merged(name: str, fresh: DataFrame, merge) -> DataFrame:
            old = state[name].drop("fingerprint").join(going_on, DATASET, "left_semi")
            return materialise(merge(fresh.unionByName(old)).join(marks.drop("rebuild"), DATASET))

        states = {
            "outlets": merged("outlets", graph.outlet_state(new.mentions, KEYS), lambda s: graph.merge_outlet_states(s, KEYS)),
            "hours": merged("hours", stacked.hour_state(new.full, KEYS, unit), lambda s: stacked.merge_hour_states(s, KEYS)),
            "newest": merged("newest", new.full.groupBy(DATASET).agg(F.max("eventDateAdded").alias("newest")),
                             lambda s: s.groupBy(DATASET).agg(F.max("newest").alias("newest"))),
            "files": todo.select(DATASET, "path", "length", "changed", "fingerprint"),
        }
        tone = materialise(graph.tone_of_state(states["outlets"], KEYS))
        dedup = materialise(stacked.dedup_of_state(states["hours"], states["newest"].select(DATASET, "newest"), KEYS))
        results = {"graph": graph.graph_of_tone(tone, KEYS, n), "stackedGraph": stacked.stacked_of_dedup(dedup, KEYS, top)}
        write_parts(results, results_dir, fmt=fmt, partition_by=KEYS, dynamic=True)
        # the files last: until then an interrupted run's datasets do not agree with themselves
        for name, df in states.items():
            (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DATASET)
             .parquet(f"{state_dir.rstrip('/')}/{name}"))
        return paths
