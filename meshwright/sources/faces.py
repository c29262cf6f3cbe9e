"""Flat faces with corners that point in and with holes, cut into triangles.

Convex faces of one loop are cut as fans, by array functions. The others go to ``cut_rings`` in Arrow batches: holes are
joined to the outline by bridges, then corners are clipped off. A face of n points and h holes gives n + 2 h - 2 triangles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..operators.solid import fixed


def fan(points: Column) -> Column:
    """Triangles of a convex loop, as an array of arrays of three points."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(points) - 2, F.lit(1))), lambda i: F.array(points[0], F.get(points, i), F.get(points, i + 1)))


def _normal(loop: Column) -> Column:
    """The loop's area vector, twice."""
    after = lambda i: F.get(loop, (i + 1) % F.size(loop))
    part = {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}
    zero = F.struct(*(F.lit(0.0).alias(c) for c in part))
    step = lambda s, i: F.struct(*((s[c] + (F.get(loop, i)[a] - loop[0][a]) * (after(i)[b] - loop[0][b]) - (F.get(loop, i)[b] - loop[0][b]) * (after(i)[a] - loop[0][a])).alias(c) for c, (a, b) in part.items()))
    return F.aggregate(F.sequence(F.lit(0), F.size(loop) - 1), zero, step)


def convex(loop: Column) -> Column:
    """Whether no corner of a loop points in."""

    def corner(n: Column, i: Column) -> Column:
        p, q, r = (F.get(loop, (i + k) % F.size(loop)) for k in range(3))
        d, e = ({c: b[c] - a[c] for c in "xyz"} for a, b in ((p, q), (q, r)))
        across = n["x"] * (d["y"] * e["z"] - d["z"] * e["y"]) + n["y"] * (d["z"] * e["x"] - d["x"] * e["z"]) + n["z"] * (d["x"] * e["y"] - d["y"] * e["x"])
        return across >= -1e-9 * (n["x"] * n["x"] + n["y"] * n["y"] + n["z"] * n["z"])

    every = F.transform(F.array(_normal(loop)), lambda n: F.forall(F.sequence(F.lit(0), F.size(loop) - 1), lambda i: corner(n, i)))
    return (F.size(loop) <= 3) | every[0]


def with_triangles(rows: DataFrame, loops: str = "loops", out: str = "cut") -> DataFrame:
    """Adds ``out``, an array of arrays of three points, of ``loops``: arrays of points (x, y, z) of one face each, in any order.

    The loop of most area is the outline, whose sense the triangles take; the others are holes, whatever their sense. Loops
    of less than three points are left out; null or no loops give no triangle. A loop that crosses itself gets as many
    triangles, in no defined arrangement.
    """
    empty = F.array().cast(rows.schema[loops].dataType)  # triangles are arrays of points too
    r = rows.withColumn("_loops", F.filter(F.coalesce(F.col(loops), empty), lambda p: F.size(p) >= 3))
    r = r.withColumn("_fan", (F.size("_loops") == 1) & convex(F.get("_loops", F.lit(0))))
    odd = F.when(F.coalesce("_fan", F.lit(True)), empty).otherwise(F.col("_loops"))
    numbers = F.flatten(F.transform(F.flatten(odd), lambda q: F.array(q["x"], q["y"], q["z"])))
    # held, since a filter on the triangles' number would else take the Python call below a join
    r = fixed(r.withColumn("_places", cut_rings(numbers, F.transform(odd, lambda p: F.size(p)))))
    points = F.flatten("_loops")
    clipped = F.when(F.size("_places") >= 3, F.transform(F.sequence(F.lit(0), F.greatest(F.size("_places") - 3, F.lit(0)), F.lit(3)), lambda k: F.array(*(F.get(points, F.get("_places", k + i)) for i in range(3)))))
    return r.withColumn(out, F.coalesce(F.when(F.col("_fan"), fan(F.get("_loops", F.lit(0)))), clipped, empty)).drop("_loops", "_fan", "_places")


def _turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Twice the signed area of triangles in the plane."""
    return (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])


def _sees(p: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether no side a-b meets the line from p to q, but for sides that end at p or q."""
    away = ~np.any([(e == o).all(1) for e in (a, b) for o in (p, q)], axis=0)
    a, b = a[away], b[away]
    one, two = _turn(p, q, a) * _turn(p, q, b), _turn(a, b, p[None]) * _turn(a, b, q[None])
    return not ((one <= 0) & (two <= 0)).any()


def _bridged(plane: np.ndarray, ring: list[int], hole: list[int], others: list[list[int]]) -> list[int]:
    """``ring`` with ``hole`` joined to it: from the hole's outermost point to the nearest corner that it sees."""
    k = int(np.argmax(plane[hole, 0]))
    hole = hole[k:] + hole[:k]
    p = plane[hole[0]]
    loops = [np.array(x) for x in (ring, hole, *others)]
    a, b = (plane[np.concatenate(x)] for x in (loops, [np.roll(x, -1) for x in loops]))
    at = np.argsort(((plane[ring] - p) ** 2).sum(1), kind="stable")
    for i in at:
        before, here, after = (plane[ring[(i + d) % len(ring)]] for d in (-1, 0, 1))
        left = (_turn(before, here, p) > 0, _turn(here, after, p) > 0)
        if (all if _turn(before, here, after) >= 0 else any)(left) and _sees(p, here, a, b):
            break
    else:
        i = at[0]
    return ring[: i + 1] + hole + [hole[0]] + ring[i:]


def _clipped(plane: np.ndarray, ring: list[int]) -> list[tuple[int, int, int]]:
    out, ring = [], list(ring)
    while len(ring) > 3:
        n = len(ring)
        pts = plane[ring]
        turn = _turn(np.roll(pts, 1, 0), pts, np.roll(pts, -1, 0))
        for i in np.flatnonzero(turn > 0):
            a, b, c = pts[i - 1], pts[i], pts[(i + 1) % n]
            inside = (_turn(a, b, pts) >= 0) & (_turn(b, c, pts) >= 0) & (_turn(c, a, pts) >= 0)
            inside &= ~((pts == a).all(1) | (pts == b).all(1) | (pts == c).all(1))
            if not inside.any():
                break
        else:  # no corner is free: the flattest goes, so that every point stays in a triangle
            i = int(np.argmin(np.abs(turn)))
        out.append((ring[i - 1], ring[i], ring[(i + 1) % n]))
        del ring[i]
    return [*out, tuple(ring)]


def clipped(loops: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """Triangles of a face as places in its loops' points laid end to end."""
    points = np.concatenate(loops)
    first = np.cumsum([0, *map(len, loops)])
    normal = lambda p: np.cross(p - p[0], np.roll(p - p[0], -1, 0)).sum(0)
    normals = np.array([normal(p) for p in loops])
    outer = int(np.argmax((normals**2).sum(1)))
    axis = int(np.argmax(np.abs(normals[outer])))
    plane = points[:, [(axis + 1) % 3, (axis + 2) % 3]]
    if normals[outer, axis] < 0:
        plane = plane[:, ::-1]
    rings = [list(range(i, j)) for i, j in zip(first[:-1], first[1:], strict=True)]
    ring = rings.pop(outer)
    area = lambda r: (_turn(plane[r[0]], plane[r], plane[np.roll(r, -1)])).sum()
    holes = sorted((r[::-1] if area(r) > 0 else r for r in rings), key=lambda r: -plane[r, 0].max())
    for k, hole in enumerate(holes):
        ring = _bridged(plane, ring, hole, holes[k + 1 :])
    return _clipped(plane, ring)


@F.pandas_udf(ArrayType(IntegerType()))
def cut_rings(numbers: pd.Series, sizes: pd.Series) -> pd.Series:
    """``clipped`` of faces given as their points' numbers end to end and the loops' sizes; three places a triangle."""
    out = []
    for x, n in zip(numbers, sizes, strict=True):
        loops = np.split(np.asarray(x, float).reshape(-1, 3), np.cumsum(n)[:-1]) if len(n) else []
        out.append(np.array(clipped(loops) if loops else [], np.int32).ravel())
    return pd.Series(out)
