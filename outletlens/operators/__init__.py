"""DataFrame -> DataFrame operators: selection, preparation, graph, stacked
series and the example analysis. All lazy; no action inside."""
