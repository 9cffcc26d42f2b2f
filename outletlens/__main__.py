"""Command line: ``python -m outletlens <command>`` (or through spark-submit).

  run             select one parameter set and write every task part (cached)
  create-dataset  select, save the flat CSV dataset and its results
  rerun-datasets  recompute the results of every saved dataset in one job
  watch-datasets  same, incrementally, for datasets whose files arrived
  empty-cache     drop cached results (all, or one parameter set)

Source tables are parquet folders partitioned by ``part_day``.
"""

from __future__ import annotations

import argparse
import json

from outletlens.params import DATASET_PRESETS, Params, preset


def _params(a) -> Params:
    if a.preset:
        return preset(a.preset)
    return Params(a.begin, a.end, a.min_sources, a.confidence,
                  None if a.limit is not None and a.limit < 0 else a.limit, a.regex)


def _add_params(p: argparse.ArgumentParser) -> None:
    d = Params()
    p.add_argument("--mentions", required=True, help="mentions table (parquet, partitioned by part_day)")
    p.add_argument("--events", required=True, help="events table (parquet, partitioned by part_day)")
    p.add_argument("--preset", choices=sorted(DATASET_PRESETS))
    p.add_argument("--begin", default=d.date_begin)
    p.add_argument("--end", default=d.date_end)
    p.add_argument("--min-sources", type=int, default=d.minimum_distinct_source_count)
    p.add_argument("--confidence", type=int, default=d.confidence)
    p.add_argument("--limit", type=int, default=d.limit, help="-1 for no limit")
    p.add_argument("--regex", default=d.filter_mention_id)


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="outletlens")
    sub = ap.add_subparsers(dest="cmd", required=True)
    r = sub.add_parser("run")
    _add_params(r)
    r.add_argument("--cache", default=None, help="folder of cached results; none: no cache")
    r.add_argument("--refresh", action="store_true")
    c = sub.add_parser("create-dataset")
    _add_params(c)
    c.add_argument("--name", required=True)
    c.add_argument("--datasets", required=True)
    c.add_argument("--results", required=True)
    for name in ("rerun-datasets", "watch-datasets"):
        b = sub.add_parser(name)
        b.add_argument("--datasets", required=True)
        b.add_argument("--results", required=True)
        b.add_argument("--format", default="json", choices=["json", "parquet"])
        if name == "watch-datasets":
            b.add_argument("--checkpoint", default=None)
    e = sub.add_parser("empty-cache")
    e.add_argument("--cache", required=True)
    a = ap.parse_args(argv)

    from outletlens.session import build_session
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession() or build_session()
    if a.cmd in ("run", "create-dataset"):
        from outletlens.sources.fixtures import SourceTables
        from outletlens.sources.tables import read_events, read_mentions
        tables = SourceTables(read_mentions(spark, a.mentions), read_events(spark, a.events))
        if a.cmd == "run":
            from outletlens.plans.pipeline import run_pipeline
            res = run_pipeline(spark, tables, _params(a), a.cache, source=json.dumps([a.mentions, a.events]),
                               refresh=a.refresh)
            print(json.dumps({"empty": True} if "empty" in res else
                             {t: sorted(parts) for t, parts in res.items()}))
        else:
            from outletlens.plans.pipeline import create_dataset
            create_dataset(spark, tables, _params(a), a.name, a.datasets, a.results)
    elif a.cmd == "rerun-datasets":
        from outletlens.plans.batch import run_all_datasets
        run_all_datasets(spark, a.datasets, a.results, fmt=a.format)
    elif a.cmd == "watch-datasets":
        from outletlens.streaming import rerun_on_new_datasets
        rerun_on_new_datasets(spark, a.datasets, a.results, a.checkpoint, fmt=a.format).awaitTermination()
    elif a.cmd == "empty-cache":
        from outletlens.plans.pipeline import invalidate_cache
        invalidate_cache(spark, a.cache)
    print("done")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
