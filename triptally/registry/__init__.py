"""Registered queries over the derived spend tables, each with its plain-SQL counterpart."""

from triptally.registry import (  # noqa: F401  (importing registers)
    aggregates,
    filters,
    indices,
    joins,
    ordering,
    scalars,
    tables,
    windows,
)
from triptally.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
