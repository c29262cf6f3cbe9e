"""The next row in the order of a group, without a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.cut import cut


def following(rows: DataFrame, group: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` with ``next``: the following row of the same group as a struct, null for the last.

    Rows are parted by ranges of (group, order) and looked ahead within a part; the last row of a part gets the first row of
    the group's next part, of which there is one a part. The ranges are drawn once and written, as later steps rely on them.
    """
    own = rows.columns
    ranged = rows.repartitionByRange(*([parts] if parts else []), *group, *order)
    placed = cut(ranged.withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy("_part", *group).orderBy(*order)
    # all of a part's rows are in one task anyway, so this shuffle moves whole parts
    ahead = placed.withColumn("next", F.lead(F.struct(*(F.col(f"`{c}`") for c in own))).over(within))
    first = placed.groupBy("_part", *group).agg(F.min(F.struct(*order, F.struct(*(F.col(f"`{c}`") for c in own)).alias("_row"))).alias("_m"))
    border = first.select(*group, "_part", F.lead("_m._row").over(Window.partitionBy(*group).orderBy("_part")).alias("_over"))
    out = ahead.join(border, ["_part", *group])
    return out.select(*own, F.coalesce("next", "_over").alias("next"))
