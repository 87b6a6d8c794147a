"""Reuse of large column expressions that depend on column names only.

An unresolved column is a plain expression tree, so one instance serves every query
of a JVM.  Building a large one costs thousands of JVM calls.
"""

from __future__ import annotations

from functools import cache, wraps

from pyspark import SparkContext
from pyspark.sql import Column, functions as F


def once(builder):
    """Build once per JVM and arguments."""
    build = cache(lambda _gateway, *args: builder(*args))

    @wraps(builder)
    def wrapper(*args) -> Column:
        return build(SparkContext._gateway, *args)

    return wrapper


def by_name(builder):
    """Let ``builder`` take a column or a column name; build once per name."""
    build_named = once(lambda name: builder(F.col(name)))

    @wraps(builder)
    def wrapper(column: Column | str) -> Column:
        return build_named(column) if isinstance(column, str) else builder(column)

    return wrapper
