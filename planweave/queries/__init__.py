"""The registered queries of the engine, one or more for each row of the inventory."""

from . import expressions, pipelines, relational  # noqa: F401
from .registry import ORACLES, QUERIES, ROWS

__all__ = ["ORACLES", "QUERIES", "ROWS"]
