"""outletlens: co-coverage analytics of news outlets, written as Spark DataFrame plans.

Layers:
  sources/    table readers (partitioned mentions/events), test fixtures, CSV/JSON/parquet sinks
  functions/  column expressions (integer yyyyMMddHHmmss dates, half-even cents, outlet names, top-k)
  operators/  DataFrame -> DataFrame operators: selection, preparation, graph, stacked series
  plans/      task protocol and registry, cached pipeline, batch over many datasets
  streaming/  incremental re-run of the batch plan when new dataset files arrive
"""

from outletlens.params import Params

__all__ = ["Params"]
