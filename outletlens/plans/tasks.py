"""Pluggable analyses: a task turns the prepared inputs into named DataFrames.

A task is any object with a ``task_name`` and ``run(prepared) -> dict[str,
DataFrame]``. ``run_dataset_pipeline`` builds (does not execute) every part of
every registered task over one shared, lazily planned input.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial
from typing import Protocol

from pyspark.sql import DataFrame

from outletlens.operators import example, graph, stacked
from outletlens.operators.prepare import Prepared, prepare
from outletlens.params import STACKED_TOP_OUTLETS
from outletlens.session import side_by_side


class Task(Protocol):
    task_name: str

    def run(self, prepared: Prepared) -> dict[str, DataFrame]: ...


class GraphTask:
    """Co-coverage network of the leading outlets."""

    task_name = "graph"

    def __init__(self, n: int | None = None):
        self.n = n

    def run(self, prepared: Prepared) -> dict[str, DataFrame]:
        kw = {} if self.n is None else {"n": self.n}
        return graph.graph(prepared.mentions, prepared.keys, **kw)


class StackedGraphTask:
    """Hourly connectedness of the leading outlets, with the tone drill-down."""

    task_name = "stackedGraph"

    def __init__(self, unit: str = "HOUR", exact_disagreement: bool = False,
                 short_name: bool = True, n: int = STACKED_TOP_OUTLETS):
        self.unit = unit
        self.n = n
        self.exact_disagreement = exact_disagreement
        self.short_name = short_name

    def run(self, prepared: Prepared) -> dict[str, DataFrame]:
        return stacked.stacked(prepared.full, prepared.keys, unit=self.unit, n=self.n,
                               short_name=self.short_name,
                               exact_disagreement=self.exact_disagreement)


class ExampleTask:
    """The ten most covered events and their mentions (not registered by default)."""

    task_name = "ExampleTask"

    def run(self, prepared: Prepared) -> dict[str, DataFrame]:
        return example.example(prepared.events, prepared.mentions, prepared.keys)


TASKS: tuple[Task, ...] = (GraphTask(), StackedGraphTask())


def registry(tasks: Sequence[Task]) -> dict[str, Task]:
    """Tasks by name; results are filed under it, so it must be there and be the only one."""
    by_name = {getattr(t, "task_name", None) or "": t for t in tasks}
    if "" in by_name or len(by_name) < len(tasks):
        raise ValueError("tasks need distinct names: " + ", ".join(repr(getattr(t, "task_name", None)) for t in tasks))
    return by_name


def run_dataset_pipeline(flat: DataFrame, tasks: Sequence[Task] = TASKS,
                         keys: Sequence[str] = ()) -> dict[str, dict[str, DataFrame]]:
    """Plan every task over ``flat``: ``{task_name: {part: DataFrame}}``. Tasks write their shared
    tables while they plan; those jobs of different tasks run side by side."""
    named = registry(tasks)
    prepared = prepare(flat, keys)
    return dict(zip(named, side_by_side([partial(task.run, prepared) for task in named.values()])))
