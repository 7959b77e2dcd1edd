"""Registered queries: one per operator, each with the SQL that must give the same rows."""

from quantframe.catalog.registry import QUERIES, Query, load_all

__all__ = ["QUERIES", "Query", "load_all"]
