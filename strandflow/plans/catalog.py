"""All queries of the library, without the optional corpus operators."""

from strandflow.plans import datasets, intervals, metrics, sequences, signals, streams  # noqa: F401  they register themselves
from strandflow.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
