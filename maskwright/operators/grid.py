"""A hierarchical grid for rectangles of any size.

Cells double from level to level, and a rectangle lies in the few cells of the level that
fits it. Two rectangles that share a point share a cell at the level of the larger one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grid_level(box: str, cell: float) -> Column:
    """How often ``cell`` has to be doubled to be as large as a box's longer side."""
    side = F.greatest(F.col(f"{box}.width"), F.col(f"{box}.height"), F.lit(float(cell))) / cell
    level = F.ceil(F.log2(side)).cast("int")
    return level + F.when(F.pow(F.lit(2.0), level) < side, 1).otherwise(0)  # if the logarithm was rounded


def grid_cells(df: DataFrame, others: list[int], cell: float, box: str = "box") -> DataFrame:
    """Spread boxes over the cells of a hierarchical grid: at a box's own level, where it
    takes four cells at most (nine at the rounding of an edge), and at those higher levels
    where the other side has boxes."""
    own = df.withColumn("__own", grid_level(box, cell))
    higher = F.filter(F.lit(sorted(others)).cast("array<int>"), lambda x: x > F.col("__own"))
    at = own.withColumn("__level", F.explode(F.concat(F.array("__own"), higher)))
    size = F.pow(F.lit(2.0), F.col("__level")) * cell
    span = lambda low, length: F.sequence(
        F.floor(F.col(f"{box}.{low}") / size),
        F.floor((F.col(f"{box}.{low}") + F.greatest(F.col(f"{box}.{length}"), F.lit(0.0))) / size),
    )
    return at.withColumn("__cx", F.explode(span("x", "width"))).withColumn("__cy", F.explode(span("y", "height")))
