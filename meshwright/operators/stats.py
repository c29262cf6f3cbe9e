"""Statistics, outliers, comparison of models, profile steps and threshold sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.cut import cut
from .select import FEW, order_statistics
from .spread import attach, evenly


def distribution(values: DataFrame, group: str, value: str = "value", few: int = FEW) -> DataFrame:
    """n, min, max, mean, median and population deviation of values that are neither null nor 0."""
    v = values.where(F.col(value).isNotNull() & (F.col(value) != 0))
    plain = v.groupBy(group).agg(F.count("*").alias("n"), F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.avg(value).alias("mean_value"), F.stddev_pop(value).alias("std_value"))
    return evenly(plain, order_statistics(v, group, value, {"median_value": 0.5}, few).drop("n"), group)


def mad_outliers(values: DataFrame, group: str, key: str, value: str = "value", limit: float = 3.0, few: int = FEW) -> DataFrame:
    """Values whose modified z score 0.6745 (x - median) / MAD exceeds the limit, in groups of three or more."""
    v = values.where(F.col(value).isNotNull() & (F.col(value) != 0)).select(group, key, value)
    mid = cut(order_statistics(v, group, value, {"_m": 0.5}, few).where("n >= 3").drop("n"))
    off = attach(v, mid, [group]).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    mad = cut(order_statistics(off, group, "_d", {"_mad": 0.5}, few).where("_mad >= 1e-10").drop("n"))
    out = attach(off, mad, [group]).withColumn("z", F.expr(f"0.6745D * ({value} - _m) / _mad"))
    return out.where(F.abs("z") > limit).select(group, key, value, "z")


def last_of_each(rows: DataFrame, match: str, order: str) -> DataFrame:
    """Of rows with the same match key the last by ``order``."""
    others = [c for c in rows.columns if c != match]
    return rows.groupBy(match).agg(F.max_by(F.struct(*others), order).alias("_r")).select(match, "_r.*")


def compare(a: DataFrame, b: DataFrame, match: str, tolerances: dict[str, float], order: str = "element_id") -> tuple[DataFrame, DataFrame]:
    """Deviations (match, property, a, b, diff, exceeds) of matched elements, and unmatched ones (match, side).

    A match key that repeats counts once, with its last element; missing values count as 0.
    """
    a, b = last_of_each(a, match, order), last_of_each(b, match, order)
    values = lambda d, p: d.select(match, *(F.coalesce(F.col(c), F.lit(0)).cast("double").alias(f"{p}_{c}") for c in tolerances))
    met = evenly(values(a, "a"), values(b, "b"), match)
    one = F.explode(F.array(*(F.struct(F.lit(c).alias("property"), F.col(f"a_{c}").alias("a_value"), F.col(f"b_{c}").alias("b_value"), F.lit(t).alias("tolerance")) for c, t in tolerances.items())))
    out = met.select(match, one.alias("p")).select(match, "p.*").withColumn("diff", F.abs(F.col("a_value") - F.col("b_value"))).withColumn("exceeds", F.col("diff") > F.col("tolerance"))
    only = evenly(a.select(match), b.select(match), match, "left_anti").withColumn("side", F.lit("a")).union(evenly(b.select(match), a.select(match), match, "left_anti").withColumn("side", F.lit("b")))
    return out, only


def profile_steps(profile: DataFrame, group: str, order: list[str], value: str = "value", jump: float = 50.0) -> DataFrame:
    """Steps of a profile: first differences of its inner 70 percent that stand out from their median by over three
    robust deviations and ``jump``; profiles of less than five values have none."""
    w = Window.partitionBy(group).orderBy(*order)
    p = profile.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(group))}).where("_n >= 5 AND _i >= floor(_n * 0.15) AND _i < _n - floor(_n * 0.15)")
    d = p.withColumn("step", F.col(value) - F.lag(value).over(w)).where("step IS NOT NULL")
    mid = d.groupBy(group).agg(F.median("step").alias("_m"))
    off = evenly(d, mid, group).withColumn("_d", F.abs(F.col("step") - F.col("_m")))
    mad = off.groupBy(group).agg((F.median("_d") / 0.6745).alias("_s"))
    return evenly(off, mad, group).where(F.expr(f"_s > 1e-10 AND _d > 3 * _s AND abs(step) > {jump}D")).select(group, "_i", "step").withColumnRenamed("_i", "position")


def sweep(values: DataFrame, column: str, start: float, stop: float, step: float) -> DataFrame:
    """How many values pass ``column >= threshold`` at each threshold of a grid: one pass, then a running sum."""
    n = int(round((stop - start) / step))
    slot = F.greatest(F.lit(-1), F.least(F.lit(n), F.floor((F.col(column) - start) / step).cast("int")))
    counts = values.where(F.col(column).isNotNull()).groupBy(slot.alias("i")).agg(F.count("*").alias("n"))
    grid = values.sparkSession.range(n + 1).select(F.col("id").cast("int").alias("i"))
    met = grid.join(counts, "i", "left")
    return met.select((F.lit(start) + F.col("i") * step).alias("threshold"), F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy(F.desc("i"))).alias("passing"))


def normal_consistency(tris: DataFrame, key: str = "element_id") -> DataFrame:
    """Elements of four or more faces in which the rarer sign of the faces' volumes about the centre holds over 30 percent."""
    mid = tris.groupBy(key).agg(*(F.avg(F.expr(f"({c}0 + {c}1 + {c}2) / 3")).alias(f"m{c}") for c in "xyz"), F.count("*").alias("n"))
    v = evenly(tris, mid, key).withColumn("_v", F.expr("(x0 - mx) * ((y1 - my) * (z2 - mz) - (z1 - mz) * (y2 - my)) + (y0 - my) * ((z1 - mz) * (x2 - mx) - (x1 - mx) * (z2 - mz)) + (z0 - mz) * ((x1 - mx) * (y2 - my) - (y1 - my) * (x2 - mx))"))
    s = v.groupBy(key).agg(F.count_if(F.col("_v") > 0).alias("pos"), F.count_if(F.col("_v") < 0).alias("neg"), F.max("n").alias("n"))
    return s.withColumn("minority", F.expr("least(pos, neg) / n")).withColumn("inconsistent", F.expr("n >= 4 AND minority > 0.3"))
