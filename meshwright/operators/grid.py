"""Boxes of mixed size in a hierarchy of grids: cells of a level are twice as wide as those of the level below.

A box lives at the lowest level whose cells are at least as wide as it is, in four cells at most, and is looked up at
every level in use, again in four cells at most. So a large box among small ones costs neither of them many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels are numbers of doublings of a metre; smaller boxes share the lowest.
LOWEST = -2


def level(extent: Column) -> Column:
    return F.greatest(F.ceil(F.log2(F.greatest(extent, F.lit(2.0**LOWEST)))), F.lit(LOWEST)).cast("int")


def width(of: Column) -> Column:
    return F.pow(F.lit(2.0), of)


def levels(leveled: DataFrame) -> list[int]:
    """Levels in use: as many numbers at most as a double has exponents."""
    return sorted(r["_level"] for r in leveled.select("_level").distinct().collect())


def resident(boxes: DataFrame, bounds: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Adds ``_level``; ``bounds`` are the least and greatest place of a box on each axis of the plan."""
    return boxes.withColumn("_level", level(F.greatest(*(hi - lo for lo, hi in bounds.values()))))


def cells(boxes: DataFrame, at: Column, bounds: dict[str, tuple[Column, Column]]) -> DataFrame:
    """A row for each cell of level ``at`` that a box overlaps: ``_c`` and the axis, with the first of them as ``_f`` and the axis."""
    out = boxes
    for c, (lo, hi) in bounds.items():
        out = out.withColumn(f"_f{c}", F.floor(lo / width(at)))
        out = out.withColumn(f"_c{c}", F.explode(F.sequence(F.col(f"_f{c}"), F.floor(hi / width(at)))))
    return out
