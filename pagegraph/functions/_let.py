"""Naming an expression, so that what is built on it refers to one value and not to a copy for each use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once for each row."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
