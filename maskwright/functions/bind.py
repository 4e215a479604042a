"""Evaluate an expression once and use it many times.

Catalyst inlines an aliased expression wherever it is referenced when it merges
projections or pushes a filter down. A value bound as a lambda argument is evaluated
once per row whatever happens around it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), 0)
