"""L1: scalar aggregates of triangle soups (keys, fid, a, b, c, x0..z2), one shuffle by element at most.

Degenerate triangles keep their normal as zero; elements without triangles give no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.cut import cut
from .select import order_statistics
from .spread import attach, evenly

KEY = "element_id"


def normals(tris: DataFrame) -> DataFrame:
    """Adds nx, ny, nz (cross product), unit normal ux, uy, uz and area."""
    cross = {
        "nx": "(y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0)",
        "ny": "(z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0)",
        "nz": "(x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0)",
    }
    out = tris.withColumns({k: F.expr(v) for k, v in cross.items()}).withColumn("_len", F.expr("sqrt(nx * nx + ny * ny + nz * nz)"))
    unit = {f"u{k}": F.expr(f"n{k} / IF(_len = 0, 1D, _len)") for k in "xyz"}
    return out.withColumns(unit | {"area": F.expr("_len / 2")}).drop("_len")


def signed_volume(tris: DataFrame, key: str = KEY) -> DataFrame:
    """(key, signed_volume, volume): sum of tetrahedra over the origin; exact for dyadic coordinates."""
    part = "x0 * (y1 * z2 - z1 * y2) + y0 * (z1 * x2 - x1 * z2) + z0 * (x1 * y2 - y1 * x2)"
    return tris.groupBy(key).agg(F.expr(f"sum({part}) / 6").alias("signed_volume")).withColumn("volume", F.abs("signed_volume"))


def centred_volume(tris: DataFrame, key: str = KEY) -> DataFrame:
    """As ``signed_volume`` about each element's own corner: stable far from the origin."""
    near = tris.groupBy(key).agg(*(F.expr(f"min(least({c}0, {c}1, {c}2))").alias(f"_{c}") for c in "xyz"))
    moved = evenly(tris, near, key).withColumns({f"{c}{i}": F.expr(f"{c}{i} - _{c}") for i in range(3) for c in "xyz"})
    return signed_volume(moved, key)


def total_area(tris: DataFrame, key: str = KEY) -> DataFrame:
    return normals(tris).groupBy(key).agg(F.sum("area").alias("total_area"))


def bounding_box(verts: DataFrame, key: str = KEY) -> DataFrame:
    """Over all vertices, referenced or not."""
    out = verts.groupBy(key).agg(*(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))))
    return out.withColumns({f"size_{c}": F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"})


def surface_centroid(tris: DataFrame, key: str = KEY) -> DataFrame:
    """Area-weighted mean of triangle centroids; the plain mean where the area is zero."""
    mean = {c: f"({c}0 + {c}1 + {c}2) / 3" for c in "xyz"}
    return normals(tris).groupBy(key).agg(*(F.expr(f"coalesce(try_divide(sum({m} * area), sum(area)), avg({m}))").alias(f"c{c}") for c, m in mean.items()))


def edges(tris: DataFrame, key: str = KEY) -> DataFrame:
    """Undirected edges, a row a triangle side: (key, fid, lo, hi)."""
    side = F.array(*(F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")) for a, b in (("a", "b"), ("b", "c"), ("c", "a"))))
    return tris.select(key, "fid", F.explode(side).alias("e")).select(key, "fid", "e.lo", "e.hi")


def watertight(tris: DataFrame, key: str = KEY) -> DataFrame:
    """Every undirected edge occurs exactly twice."""
    per_edge = edges(tris, key).groupBy(key, "lo", "hi").agg(F.count("*").alias("n"))
    return per_edge.groupBy(key).agg(F.min(F.col("n") == 2).alias("is_watertight"), F.count("*").alias("num_edges"), F.count_if(F.col("n") != 2).alias("non_manifold_edges"))


def drop_degenerate(tris: DataFrame, key: str = KEY) -> DataFrame:
    """Triangles whose area exceeds (box diagonal * 1e-8)**2, where at least four do; all others stay whole.

    Adds ``n_degenerate`` to each row.
    """
    box = cut(tris.groupBy(key).agg(F.expr(" + ".join(f"pow(max(greatest({c}0, {c}1, {c}2)) - min(least({c}0, {c}1, {c}2)), 2)" for c in "xyz")).alias("_box")))
    out = attach(normals(tris), box, [key]).withColumn("_fine", F.expr("area > _box * 1e-16"))
    left = cut(out.groupBy(key).agg(F.count_if(~F.col("_fine")).alias("n_degenerate"), F.count_if("_fine").alias("_left")))
    return attach(out, left, [key]).where("_fine OR _left < 4").drop("_fine", "_left", "_box")


def repair_winding(tris: DataFrame, key: str = KEY) -> DataFrame:
    """b and c swapped where a closed mesh of at least four triangles is inside out; adds ``normals_flipped``."""
    state = evenly(evenly(signed_volume(tris, key), watertight(tris, key), key), tris.groupBy(key).agg(F.count("*").alias("_n")), key)
    state = state.select(key, F.expr("is_watertight AND signed_volume < 0 AND _n >= 4").alias("normals_flipped"))
    swap = {f"{p}{i}": F.expr(f"IF(normals_flipped, {p}{3 - i}, {p}{i})") for p in "xyz" for i in (1, 2)}
    return evenly(tris, state, key).withColumns(swap | {"b": F.expr("IF(normals_flipped, c, b)"), "c": F.expr("IF(normals_flipped, b, c)")})


def quality(tris: DataFrame, key: str = KEY) -> DataFrame:
    """Area and edge-length statistics; each triangle counts its own three sides."""
    n = normals(tris)
    length = F.explode(F.array(*(F.expr(f"sqrt(pow(x{i} - x{j}, 2) + pow(y{i} - y{j}, 2) + pow(z{i} - z{j}, 2))") for i, j in ((0, 1), (1, 2), (2, 0)))))
    areas = n.groupBy(key).agg(F.min("area").alias("min_area"), F.max("area").alias("max_area"), F.count("*").alias("num_triangles"))
    areas = cut(evenly(areas, order_statistics(n, key, "area", {"median_area": 0.5}).drop("n"), key))
    tiny = attach(n, areas.select(key, "median_area"), [key]).groupBy(key).agg(F.count_if(F.col("area") < F.col("median_area") * 1e-10).alias("degenerate"))
    every = tris.select(key, length.alias("s"))
    sides = evenly(every.groupBy(key).agg(F.min("s").alias("min_edge"), F.max("s").alias("max_edge")), order_statistics(every, key, "s", {"median_edge": 0.5}).drop("n"), key)
    return evenly(evenly(evenly(areas, tiny, key), sides, key), watertight(tris, key), key)


def level1(verts: DataFrame, tris: DataFrame, key: str = KEY) -> DataFrame:
    """All of L1, a row an element."""
    out = signed_volume(tris, key)
    for more in (total_area(tris, key), bounding_box(verts, key), surface_centroid(tris, key), watertight(tris, key), tris.groupBy(key).agg(F.count("*").alias("num_triangles"))):
        out = evenly(out, more, key)
    return out
