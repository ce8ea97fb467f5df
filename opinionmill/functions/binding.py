"""Evaluate an expression once and use it several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    A plain column would be copied into every place that reads it when Spark
    pushes a filter below a projection; a lambda argument is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
