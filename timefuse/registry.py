"""Registered queries over the input tables and their DuckDB oracle SQL.

Each query reads whole tables (no id subsets, no row caps); doubles are
rounded to 6 places on both sides so the engines compare equal. Importing
this module loads every query module.
"""

from __future__ import annotations

from . import queries_core  # noqa: F401
from . import queries_io  # noqa: F401
from . import queries_model  # noqa: F401
from .catalog import ORACLE, QUERIES, register

__all__ = ["QUERIES", "ORACLE", "register"]
