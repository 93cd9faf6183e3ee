"""The registered queries: each operator on the given tables, with its SQL twin where SQL can say it."""

from . import als, events, joins, model_free, prep, scenarios, stats  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
