"""Registered queries over the driver tables, with their DuckDB oracle SQL."""
from .registry import QUERIES, ORACLE_SQL, register  # noqa: F401
from . import catalog  # noqa: F401  (registers every query on import)
