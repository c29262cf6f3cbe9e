"""Meshes too large for a row: L1, welding, bodies, coplanar groups and crown widths from a row a triangle.

Elements of at most ``limit`` triangles take the array plan (``solid``), which needs one shuffle; larger ones stay spread out.
Their sums are added up before they are shuffled, sides meet by side and triangles by number, and components are closed within
blocks of triangles first and across them by joins. Both plans give the same columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.cut import cut
from . import graph, mesh, solid
from .mesh import KEY
from .ordered import following
from .spread import attach, evenly

#: Triangles that one row of a table may hold.
LIMIT = 100_000
BOX = [f"{n}_{c}" for c in "xyz" for n in ("min", "max", "size")]
LEVEL1 = ["num_triangles", "num_edges", "non_manifold_edges", "is_watertight", "normals_flipped", "signed_volume", "volume", "total_area", "cx", "cy", "cz", *BOX]
GROUP = ["group_id", "num_triangles", "area", *(f"{p}{c}" for p in "pg" for c in "xyz")]


def parted(tris: DataFrame, limit: int = LIMIT, key: str = KEY) -> tuple[DataFrame, DataFrame | None]:
    """Triangles of small elements, and of large ones (None without any)."""
    heavy = cut(tris.groupBy(key).count().where(F.col("count") > limit).select(key))
    if heavy.isEmpty():
        return tris, None
    return attach(tris, heavy, [key], "left_anti"), cut(attach(tris, heavy, [key], "left_semi"))


def vertices(tris: DataFrame, key: str = KEY) -> DataFrame:
    """(key, vid, x, y, z) of the corners, each once."""
    corner = F.array(*(F.struct(F.col(v).alias("vid"), *(F.col(f"{c}{i}").alias(c) for c in "xyz")) for i, v in enumerate("abc")))
    return tris.select(key, F.explode(corner).alias("p")).groupBy(key, "p.vid").agg(*(F.first(f"p.{c}").alias(c) for c in "xyz"))


def _shape(tris: DataFrame, key: str) -> DataFrame:
    """A row an element: what level 1 knows, volumes about the mean of the vertices."""
    box = cut(vertices(tris, key).groupBy(key).agg(*(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))), *(F.avg(c).alias(f"_o{c}") for c in "xyz")))
    near = attach(tris, box.select(key, "_ox", "_oy", "_oz"), [key]).withColumns({f"{c}{i}": F.col(f"{c}{i}") - F.col(f"_o{c}") for c in "xyz" for i in range(3)})
    six = "x0 * (y1 * z2 - z1 * y2) + y0 * (z1 * x2 - x1 * z2) + z0 * (x1 * y2 - y1 * x2)"
    middle = {c: f"({c}0 + {c}1 + {c}2) / 3" for c in "xyz"}
    sums = mesh.normals(near).groupBy(key).agg(F.count("*").alias("num_triangles"), F.sum("area").alias("total_area"), (F.sum(F.expr(six)) / 6).alias("signed_volume"), *(F.expr(f"coalesce(try_divide(sum({m} * area), sum(area)), avg({m}))").alias(f"_m{c}") for c, m in middle.items()))
    out = evenly(evenly(sums, box, key), mesh.watertight(tris, key), key)
    out = out.withColumns({f"size_{c}": F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"} | {f"c{c}": F.col(f"_o{c}") + F.col(f"_m{c}") for c in "xyz"} | {"volume": F.abs("signed_volume")})
    return out.withColumn("normals_flipped", F.col("is_watertight") & (F.col("signed_volume") < 0) & (F.col("num_triangles") >= 4)).select(key, *LEVEL1)


def level1(tris: DataFrame, limit: int = LIMIT, key: str = KEY) -> DataFrame:
    """(key and ``LEVEL1``), a row an element of any size."""
    small, large = parted(tris, limit, key)
    s = solid.with_centroid(solid.faced(solid.rows(small, key)))
    s = s.selectExpr(key, "cast(size(t) as bigint) AS num_triangles", f"{solid.total('t', lambda x: x['area'])} AS total_area", *(c for c in LEVEL1 if c not in ("num_triangles", "total_area"))).select(key, *LEVEL1)
    return s if large is None else s.unionByName(_shape(large, key))


def faced(tris: DataFrame, key: str = KEY) -> DataFrame:
    """Triangles wound outwards, with unit normal ux, uy, uz, area and centroid mx, my, mz."""
    flips = cut(_shape(tris, key).select(key, "normals_flipped"))
    swap = {f"{p}{i}": F.expr(f"IF(normals_flipped, {p}{3 - i}, {p}{i})") for p in "xyz" for i in (1, 2)}
    turned = attach(tris, flips, [key]).withColumns(swap | {"b": F.expr("IF(normals_flipped, c, b)"), "c": F.expr("IF(normals_flipped, b, c)")})
    return mesh.normals(turned).withColumns({f"m{c}": F.expr(f"({c}0 + {c}1 + {c}2) / 3") for c in "xyz"}).drop("nx", "ny", "nz", "normals_flipped")


def adjacency(tris: DataFrame, key: str = KEY) -> DataFrame:
    """(key, f, g): triangles with the first one of a side that they share, however many share it."""
    sides = mesh.edges(tris, key)
    first = sides.groupBy(key, "lo", "hi").agg(F.min("fid").alias("f"))
    return evenly(sides, first, [key, "lo", "hi"]).where("fid <> f").select(key, "f", F.col("fid").alias("g")).distinct()


#: Triangles by number whose pairs one task closes.
BLOCK = 1 << 16


def components(tris: DataFrame, pairs: DataFrame, key: str = KEY, block: int = BLOCK) -> DataFrame:
    """(key, fid, component): the smallest fid that each triangle reaches by pairs (f, g).

    Pairs within a block of consecutive triangles are closed by one task, which holds three pairs a triangle at most; what is
    left between blocks, a graph of blocks' components, by rounds of joins.
    """
    pairs = cut(pairs.withColumn("_block", F.floor(F.col("f") / block)))
    within = pairs.where(F.floor(F.col("g") / block) == F.col("_block"))

    def close(rows: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(np.concatenate([rows.f, rows.g]), return_inverse=True)
        u, v, label = at[: len(rows)], at[len(rows) :], np.arange(len(ids))
        while (label[u] != label[v]).any():
            a, b = label[u], label[v]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label != (up := label[label])).any():
                label = up
        return pd.DataFrame({key: rows[key].iloc[0], "fid": ids, "root": ids[label]})

    kind = tris.schema[key].dataType.simpleString()
    roots = cut(within.select(key, "_block", F.col("f").cast("long").alias("f"), F.col("g").cast("long").alias("g")).groupBy(key, "_block").applyInPandas(close, f"{key} {kind}, fid long, root long"))
    of = lambda side: roots.select(key, F.col("fid").alias(side), F.col("root").alias(f"_{side}"))
    across = evenly(evenly(pairs.where(F.floor(F.col("g") / block) != F.col("_block")), of("f"), [key, "f"], "left"), of("g"), [key, "g"], "left")
    across = cut(across.select(key, F.coalesce("_f", F.col("f").cast("long")).alias("f"), F.coalesce("_g", F.col("g").cast("long")).alias("g")).where("f <> g").distinct())
    out = evenly(tris.select(key, F.col("fid").cast("long").alias("fid")), roots, [key, "fid"], "left").withColumn("root", F.coalesce("root", "fid"))
    if across.isEmpty():
        return out.select(key, "fid", F.col("root").alias("component"))
    node = lambda c: F.struct(F.col(key).alias("key"), F.col(c).alias("fid")).alias(c)
    joined = graph.propagate(across.select(node("f"), node("g"))).select(F.col("node.key").alias(key), F.col("node.fid").alias("root"), F.col("component.fid").alias("component"))
    return evenly(out, joined, [key, "root"], "left").select(key, "fid", F.coalesce("component", "root").alias("component"))


def bodies(tris: DataFrame, key: str = KEY) -> DataFrame:
    """(key, fid, component, area, num_bodies): each triangle's body, the area of it, and how many its element has."""
    body = cut(components(tris, adjacency(tris, key), key))
    area = evenly(mesh.normals(tris).select(key, F.col("fid").cast("long").alias("fid"), "area"), body, [key, "fid"]).groupBy(key, "component").agg(F.round(F.sum("area"), 6).alias("area"))
    area = cut(area)
    count = cut(area.groupBy(key).agg(F.count("*").alias("num_bodies")))
    return attach(evenly(body, area, [key, "component"]), count, [key])


def largest_body(tris: DataFrame, key: str = KEY) -> DataFrame:
    """(key, component, area, num_bodies) of the body of most area, the first of equals."""
    own = bodies(tris, key).groupBy(key, "component").agg(F.max("area").alias("area"), F.max("num_bodies").alias("num_bodies"))
    return own.groupBy(key).agg(F.max(F.struct("area", (-F.col("component")).alias("_first"))).alias("_b"), F.max("num_bodies").alias("num_bodies")).select(key, (-F.col("_b._first")).alias("component"), F.col("_b.area").alias("area"), "num_bodies")


def of_largest_body(tris: DataFrame, key: str = KEY) -> DataFrame:
    """Triangles of each element's largest body."""
    body = components(tris, adjacency(tris, key), key)
    best = cut(largest_body(tris, key).select(key, "component"))
    fids = attach(body, best.withColumnRenamed("component", "_best"), [key]).where("component = _best").select(key, "fid")
    return evenly(tris.withColumn("fid", F.col("fid").cast("long")), fids, [key, "fid"], "left_semi").select(tris.columns)


def labelled(turned: DataFrame, degrees: float = 5.0, key: str = KEY) -> DataFrame:
    """(key, fid, component): coplanar clusters of ``faced`` triangles."""
    unit = lambda side, p: turned.select(key, F.col("fid").alias(side), *(F.col(f"u{c}").alias(f"{p}{c}") for c in "xyz"))
    met = evenly(evenly(adjacency(turned, key), unit("f", "p"), [key, "f"]), unit("g", "q"), [key, "g"])
    return components(turned, met.where(f"acos(greatest(least(px * qx + py * qy + pz * qz, 1D), -1D)) < radians({degrees}D)").select(key, "f", "g"), key)


def _grouped(tris: DataFrame, degrees: float, key: str) -> tuple[DataFrame, DataFrame]:
    """Groups of ``GROUP`` and the triangles with their group."""
    turned = cut(faced(tris, key))
    rows = evenly(turned.withColumn("fid", F.col("fid").cast("long")), labelled(turned, degrees, key).withColumnRenamed("component", "group_id"), [key, "fid"])
    rows = cut(rows)
    sums = rows.groupBy(key, "group_id").agg(F.count("*").alias("num_triangles"), F.sum("area").alias("area"), *(F.sum(F.col(f"u{c}") * F.col("area")).alias(f"_n{c}") for c in "xyz"), *(F.expr(f"try_divide(sum(m{c} * area), sum(area))").alias(f"p{c}") for c in "xyz"))
    length = F.expr("sqrt(_nx * _nx + _ny * _ny + _nz * _nz)")
    return sums.withColumn("_l", length).withColumns({f"g{c}": F.expr(f"_n{c} / IF(_l = 0, 1D, _l)") for c in "xyz"}).select(key, *GROUP), rows


def groups(tris: DataFrame, limit: int = LIMIT, degrees: float = 5.0, key: str = KEY) -> DataFrame:
    """(key and ``GROUP``): coplanar groups of elements of any size."""
    small, large = parted(tris, limit, key)
    g = solid.with_groups(solid.labelled(solid.faced(solid.rows(small, key)), degrees))
    g = g.select(key, F.inline(F.transform("groups", lambda x: F.struct(*((x[c].cast("long") if c == "group_id" else x[c]).alias(c) for c in GROUP)))))
    return g if large is None else g.unionByName(_grouped(large, degrees, key)[0])


def axis(turned: DataFrame, by_area: bool = True, key: str = KEY) -> DataFrame:
    """(key, ax, ay): main direction in plan, the longer box side if round.

    Of the area-weighted centroids of ``faced`` triangles or, as a straight centreline's, of their vertices.
    """
    corners = vertices(turned, key)
    points = turned.select(key, F.col("mx").alias("x"), F.col("my").alias("y"), F.col("area").alias("w")) if by_area else corners.select(key, "x", "y", F.lit(1.0).alias("w"))
    mean = points.groupBy(key).agg(*(F.expr(f"try_divide(sum({c} * w), sum(w))").alias(f"_{c}") for c in "xy"))
    mean = cut(mean.join(corners.groupBy(key).agg(*(F.expr(f"max({c}) - min({c})").alias(f"_w{c}") for c in "xy")), key))
    s = attach(points, mean, [key]).groupBy(key, "_wx", "_wy").agg(*(F.expr(f"try_divide(sum(({p} - _{p}) * ({q} - _{q}) * w), sum(w))").alias(p + q) for p, q in ("xx", "xy", "yy")))
    s = s.withColumn("_d", F.expr("sqrt(pow((xx - yy) / 2, 2) + xy * xy)")).withColumns({"_big": F.expr("(xx + yy) / 2 + _d"), "_small": F.expr("(xx + yy) / 2 - _d")})
    s = s.withColumns({"_ex": F.expr("IF(xx >= yy, _big - yy, xy)"), "_ey": F.expr("IF(xx >= yy, xy, _big - xx)")}).withColumn("_n", F.expr("sqrt(_ex * _ex + _ey * _ey)"))
    s = s.withColumns({"_round": F.expr("_big / greatest(_small, 1e-12D) < 2 OR _n = 0"), "_sign": F.expr("IF(IF(abs(_ex) >= abs(_ey), _ex, _ey) < 0, -1D, 1D)")})
    return s.select(key, F.expr("IF(_round, IF(_wx >= _wy, 1D, 0D), _sign * _ex / _n)").alias("ax"), F.expr("IF(_round, IF(_wx >= _wy, 0D, 1D), _sign * _ey / _n)").alias("ay"))


def crown_width(tris: DataFrame, by_area: bool = False, degrees: float = 5.0, key: str = KEY) -> DataFrame:
    """(key, crown_width_mm): extent of the topmost upward surfaces across the axis, over their mean tilt; largest bodies only.

    Of the crowns' heights the largest gap, if it exceeds a millimetre and the spread on both sides of it, parts those that count.
    """
    g, rows = _grouped(of_largest_body(tris, key), degrees, key)
    crown = cut(g.where("gz > cos(radians(45D))").select(key, "group_id", "pz", "gz", "area"))
    gaps = following(crown.select(key, "pz", "group_id"), [key], ["pz", "group_id"]).where("next IS NOT NULL")
    span = crown.groupBy(key).agg(F.min("pz").alias("_lo"), F.max("pz").alias("_hi"))
    widest = gaps.select(key, "pz", F.col("next.pz").alias("_up")).groupBy(key).agg(F.max(F.struct((F.col("_up") - F.col("pz")).alias("gap"), (-F.col("pz")).alias("_below"), "_up")).alias("_g"))
    split = widest.join(span, key).where("_g.gap > greatest(-_g._below - _lo, _hi - _g._up, 1e-3D)").select(key, F.expr("(-_g._below + _g._up) / 2").alias("_mid"))
    top = cut(attach(crown, cut(split), [key], "left").where("_mid IS NULL OR pz > _mid"))
    tilt = cut(top.groupBy(key).agg(F.expr("try_divide(sum(abs(gz) * area), sum(area))").alias("_tilt")).join(axis(rows, by_area, key), key))
    faces = evenly(rows, top.select(key, "group_id"), [key, "group_id"], "left_semi")
    across = attach(faces, tilt, [key]).withColumns({f"_a{i}": F.expr(f"x{i} * ay - y{i} * ax") for i in range(3)})
    return across.groupBy(key, "_tilt").agg(F.expr("max(greatest(_a0, _a1, _a2)) - min(least(_a0, _a1, _a2))").alias("_w")).select(key, F.expr("try_divide(_w, _tilt) * 1000").alias("crown_width_mm"))
