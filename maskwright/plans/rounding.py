"""Six decimals by plain arithmetic, so that Spark and SQL round alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(value: Column) -> Column:
    return F.floor(value.cast("double") * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)
