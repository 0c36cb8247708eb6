"""Registered queries of the engine and their SQL counterparts."""

from __future__ import annotations

from . import queries_analysis, queries_formats, queries_functions, queries_search, queries_tables  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark, sf_dir):
    return QUERIES["flt10_family_search"](spark, sf_dir)
