"""Exact order statistics of groups of any size, by refining histograms.

Groups of few values are sorted in place. Of a larger group each pass counts, in equal parts of the range that still holds the
wanted rank, how many values fall into each (partial counts before the shuffle), and goes on with the part that holds it, from
its least value to its greatest. Parts are equal by size and by magnitude in turn, so values over many powers of ten are parted
soon too. A pass over smooth values leaves a thousandth of them; once few are left, or all are equal, the rank is read off. Every
other pass at least parts the least from the greatest value, so the passes end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.cut import cut
from .spread import attach

#: Values that may be sorted in one place, and parts of a range counted in a pass.
FEW = 100_000
PARTS = 1024


def _ranks(sizes: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """(group, n, lo, hi, name, side, rank): the two places between which each quantile lies."""
    each = F.array(*(F.struct(F.lit(k).alias("name"), F.lit(float(q)).alias("q")) for k, q in quantiles.items()))
    rows = sizes.select("*", F.explode(each).alias("_q")).select("*", "_q.name", (F.col("_q.q") * (F.col("n") - 1)).alias("_at"))
    side = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    rows = rows.select("*", side)
    return rows.withColumn("rank", F.least(F.floor("_at") + F.col("side"), F.col("n") - 1)).withColumn("weight", F.col("_at") - F.floor("_at")).drop("_at", "_q")


def order_statistics(values: DataFrame, group: str, value: str = "value", quantiles: dict[str, float] | None = None, few: int = FEW, parts: int = PARTS) -> DataFrame:
    """(group, n and a column for each of ``quantiles``, by default ``median``): linear between neighbours, nulls left out."""
    quantiles = quantiles or {"median": 0.5}
    rows = values.select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    sizes = cut(rows.groupBy("_g").agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")))
    large = sizes.where(F.col("n") > few)
    small = rows if large.isEmpty() else attach(rows, large.select("_g"), ["_g"], "left_anti")
    at = [F.expr(f"percentile(_v, {float(q)!r}D)").alias(k) for k, q in quantiles.items()]
    out = small.groupBy("_g").agg(F.count("*").alias("n"), *at)
    if not large.isEmpty():
        out = out.unionByName(_refined(rows, large, quantiles, few, parts))
    return out.withColumnRenamed("_g", group)


def _magnitude(v: Column) -> Column:
    """Grows with ``v`` as its logarithm does, on both sides of zero; the least double's is -745."""
    return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * (F.ln(F.abs(v)) + 746))


def _refined(rows: DataFrame, sizes: DataFrame, quantiles: dict[str, float], few: int, parts: int) -> DataFrame:
    own, magnitudes = ["_g", "name", "side"], False
    state = cut(_ranks(sizes, quantiles).withColumn("left", F.col("n")))
    while True:
        open_ = state.where(F.col("left") > few).where("lo < hi")
        if open_.isEmpty():
            break
        # both places of a quantile mostly share a range: a value is looked at once a range
        ranges = cut(open_.select("_g", "lo", "hi").distinct().groupBy("_g").agg(F.collect_set(F.struct("lo", "hi")).alias("_ranges")))
        met = attach(rows, ranges, ["_g"]).select("_g", "_v", F.explode("_ranges").alias("_r")).where("_v BETWEEN _r.lo AND _r.hi")
        # halves keep the width finite where a range spans most of the doubles
        place = _magnitude if magnitudes else lambda v: v / 2
        share = F.coalesce(F.try_divide(place(F.col("_v")) - place(F.col("_r.lo")), place(F.col("_r.hi")) - place(F.col("_r.lo"))), F.lit(0.0))
        part, magnitudes = F.least(F.floor(share * parts), F.lit(parts - 1)).cast("int"), not magnitudes
        counts = met.groupBy("_g", F.col("_r.lo").alias("lo"), F.col("_r.hi").alias("hi"), part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        before = F.sum("_n").over(Window.partitionBy("_g", "lo", "hi").orderBy("_part")) - F.col("_n")
        narrowed = open_.join(counts.withColumn("_before", before), ["_g", "lo", "hi"]).where("rank >= _before AND rank < _before + _n")
        moved = narrowed.select(*own, "n", "weight", (F.col("rank") - F.col("_before")).alias("rank"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_n").alias("left"))
        settled = state.where((F.col("left") <= few) | (F.col("lo") >= F.col("hi"))).select(moved.columns)
        state = cut(settled.unionByName(moved))
    flat = state.where("lo = hi").select(*own, "n", "weight", F.col("lo").alias("_x"))
    some = cut(state.where("lo < hi"))
    ranges = cut(some.select("_g", "lo", "hi").distinct().groupBy("_g").agg(F.collect_set(F.struct("lo", "hi")).alias("_ranges")))
    met = attach(rows, ranges, ["_g"]).select("_g", "_v", F.explode("_ranges").alias("_r")).where("_v BETWEEN _r.lo AND _r.hi")
    # at most `few` values, counted above
    held = met.groupBy("_g", F.col("_r.lo").alias("lo"), F.col("_r.hi").alias("hi")).agg(F.sort_array(F.collect_list("_v")).alias("_all"))
    read = some.join(held, ["_g", "lo", "hi"]).select(*own, "n", "weight", F.get("_all", F.col("rank").cast("int")).alias("_x"))
    found = flat.unionByName(read).groupBy("_g", "n", "name", "weight").agg(F.max(F.when(F.col("side") == 0, F.col("_x"))).alias("_a"), F.max(F.when(F.col("side") == 1, F.col("_x"))).alias("_b"))
    found = found.withColumn("_q", F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("weight"))
    return found.groupBy("_g", "n").agg(*(F.max(F.when(F.col("name") == k, F.col("_q"))).alias(k) for k in quantiles))
