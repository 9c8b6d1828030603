"""Where a module of queries keeps them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagegraph.plans.shapes import shape_sql

_MARKS = {"{e}": "entries", "{d}": "documents_of_orders", "{c}": "calls", "{r}": "raw_dates"}


def registry() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str], Callable]:
    """Queries and SQL by name, and the decorator that fills them; in SQL, {e}, {d}, {c} and {r} are the shapes."""
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    oracle: dict[str, str] = {}

    def query(sql: str | None = None):
        def keep(f):
            queries[f.__name__] = f
            if sql is not None:
                text = sql
                for mark, name in _MARKS.items():
                    text = text.replace(mark, f"({shape_sql(name)})")
                oracle[f.__name__] = text
            return f

        return keep

    return queries, oracle, query
