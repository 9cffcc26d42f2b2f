"""Incremental form of the batch re-run: a file stream over the datasets folder
triggers the keyed batch plan for exactly the datasets whose files arrived."""

from outletlens.streaming.datasets import rerun_on_new_datasets

__all__ = ["rerun_on_new_datasets"]
