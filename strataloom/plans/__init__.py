"""The engine's registered queries."""

from . import context, graphs, sequences, store, streams  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
