"""Operators wired to the driver tables, each with its SQL where SQL can say it."""

from storyloom.queries.registry import all_queries, all_sql

__all__ = ["all_queries", "all_sql"]
