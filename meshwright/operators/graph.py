"""Graphs as tables: welding, adjacency, and components of one graph of any size. Graphs within elements are in ``solid``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.cut import dropped, written
from .mesh import KEY, edges
from .spread import evenly


def weld(verts: DataFrame, decimals: int | None = None, key: str = KEY) -> DataFrame:
    """(key, vid, rep): the first vertex of the same rounded place.

    By default places have eight digits below the size of the element's diagonal, six at least.
    """
    w = Window.partitionBy(key)
    diagonal = F.sqrt(sum((F.pow(F.max(c).over(w) - F.min(c).over(w), F.lit(2)) for c in "xyz"), F.lit(0.0)))
    own = F.when(diagonal <= 1e-10, 6).otherwise(F.greatest(F.lit(6), F.ceil(-F.log10(diagonal)).cast("int") + 8)) if decimals is None else F.lit(decimals)
    verts = verts.withColumn("_unit", F.pow(F.lit(10.0), own))
    place = [F.round(F.col(c) * F.col("_unit")) for c in "xyz"]
    return verts.withColumn("rep", F.min("vid").over(Window.partitionBy(key, *place))).select(key, "vid", "rep")


def adjacency(tris: DataFrame, key: str = KEY) -> DataFrame:
    """(key, f, g): triangles that share an edge; an edge of k triangles gives k - 1 pairs with its first one."""
    per_edge = edges(tris, key).groupBy(key, "lo", "hi").agg(F.array_sort(F.collect_set("fid")).alias("fs"))
    return per_edge.where(F.size("fs") > 1).select(key, F.col("fs")[0].alias("f"), F.explode(F.slice("fs", 2, F.size("fs") - 1)).alias("g")).distinct()


def propagate(pairs: DataFrame) -> DataFrame:
    """(node, component) of one graph of pairs (f, g): nodes take over the smallest label about them, hand it to the node that their
    old label names, and then take that of the node that their label names, until none moves; rounds grow as a logarithm."""
    both, sides = written(pairs.select(F.col("f").alias("u"), F.col("g").alias("v")).union(pairs.select("g", "f")).distinct())
    label, path = written(both.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("l")))
    while True:
        near = evenly(both, label.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("l").alias("n"))
        step = evenly(label, near, "u").select("u", F.col("l").alias("was"), F.least("l", "n").alias("l"))
        hooks = step.where("l < was").groupBy(F.col("was").alias("u")).agg(F.min("l").alias("h"))
        step = evenly(step, hooks, "u", "left").select("u", "was", F.least("l", F.coalesce("h", "l")).alias("l"))
        moved, new = written(evenly(step, step.select(F.col("u").alias("l"), F.col("l").alias("up")), "l", "left").select("u", "was", F.least("l", F.coalesce("up", "l")).alias("l")))
        still = moved.where("was <> l").isEmpty()
        dropped(both, path)
        label, path = moved.select("u", "l"), new
        if still:
            dropped(both, sides)
            return label.select(F.col("u").alias("node"), F.col("l").alias("component"))
