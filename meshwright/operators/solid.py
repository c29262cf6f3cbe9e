"""Elements as rows: an element's triangles are one array, so L1 to L4 are expressions over a row, without a shuffle.

``t`` holds structs (fid, a, b, c, x0 .. z2) in the order of fid, ``v`` structs (vid, x, y, z). Groups, points and slices
are arrays too; sorting brings like things together, so work grows with n log n in an element's triangles. Closing graphs
into components is an expression too: nothing of a row goes to Python.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions
from pyspark.sql.types import ArrayType, IntegerType

from . import text as F
from .mesh import KEY
from .spread import small_batches
from .text import Sql as Column
from .text import put

CORNER = [f"{c}{i}" for i in range(3) for c in "xyz"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it's used."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def grouped(rows: Column, same: Callable[[Column], Column]) -> Column:
    """Sorted ``rows`` as arrays of rows with the same ``same``."""

    def cut(e: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(e) - 1, F.lit(0))), lambda i: (i < F.size(e)) & ((i == 0) | (same(F.get(e, i)) != same(F.get(e, i - 1)))))
        return let(starts, lambda s: F.transform(s, lambda x, k: F.slice(e, x + 1, F.coalesce(F.get(s, k + 1), F.size(e)) - x)))

    return let(rows, cut)


def gathered(label: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of each label (a whole number of 31 bits by place) and of the places that have it, both in order. One sort of
    numbers: sorting structs makes orderings of their fields for each comparison."""
    order = F.sort_array(F.transform(label, lambda g, i: Column(f"(shiftleft(CAST({g} AS BIGINT), 32) | {i})")))
    return F.transform(grouped(order, lambda e: _high(e, 32)), lambda r: body(_high(r[0], 32).cast("int"), F.transform(r, lambda e: _low(e, 32))))


def _high(e: Column, bits: int) -> Column:
    return Column(f"shiftright({e}, {bits})")


def _low(e: Column, bits: int) -> Column:
    return Column(f"CAST({e} & {(1 << bits) - 1}L AS INT)")


def _within(t: Column, bits: int) -> Column:
    """Whether the vertices' ids and the places of triangles are whole numbers of so many bits."""
    each = lambda f: F.transform(t, lambda x: f(x["a"], x["b"], x["c"]))
    return (F.array_min(each(F.least)) >= 0) & (F.array_max(each(F.greatest)) < 1 << bits) & (F.size(t) * 3 < 1 << bits)


def total(rows: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(rows, F.lit(0.0), lambda s, x: s + of(x))


def lowest(rows: Column, of: Callable[[Column], Column]) -> Column:
    return F.array_min(F.transform(rows, lambda x: of(x)))


def highest(rows: Column, of: Callable[[Column], Column]) -> Column:
    return F.array_max(F.transform(rows, lambda x: of(x)))


def percentile(ordered: Column, q: float) -> Column:
    """Linear between the neighbours of place q (n - 1) of sorted numbers; null without any."""
    at = F.lit(q) * (F.size(ordered) - 1)
    lo = F.floor(at).cast("int")
    part = at - lo
    a, b = F.get(ordered, lo), F.get(ordered, F.least(lo + 1, F.size(ordered) - 1))
    return F.when(F.size(ordered) > 0, a + (b - a) * part)


def median(values: Column) -> Column:
    return let(F.sort_array(values), lambda s: percentile(s, 0.5))


def structs(**fields: Column) -> Column:
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def fixed(solids: DataFrame) -> DataFrame:
    """Columns so far are computed before what follows: the optimizer would else write them out wherever they're read, and
    such expressions grow with each step. A condition on a row number neither merges with projections nor moves below them."""
    return put(solids, {"_row": Column("monotonically_increasing_id()")}).where("_row >= 0").drop("_row")


def held(**fields: Column) -> Column:
    """A struct column whose fields are computed once, not again wherever one of them is read."""
    return let(structs(**fields), lambda s: s)


def rows(tris: DataFrame, key: str = KEY) -> DataFrame:
    """(key, t, v) from a row a triangle: one shuffle by element."""
    met = tris.groupBy(key).agg(functions.sort_array(functions.collect_list(functions.struct("fid", "a", "b", "c", *CORNER))).alias("t"))
    corners = F.flatten(F.transform("t", lambda x: F.array(*(structs(vid=x[v], **{c: x[f"{c}{i}"] for c in "xyz"}) for i, v in enumerate("abc")))))
    return put(met, {"v": F.transform(grouped(F.sort_array(corners), lambda p: p["vid"]), lambda r: r[0])})


def edges(t: Column) -> Column:
    """Sides of the triangles as arrays of the triangles' places, one a side, in order. Vertices' ids of 21 bits make a side and
    its place one number."""
    pair = lambda x, of: F.array(*(of(F.least(x[p], x[q]), F.greatest(x[p], x[q])) for p, q in ("ab", "bc", "ca")))
    packed = lambda t: F.transform(t, lambda x, i: pair(x, lambda lo, hi: Column(f"(shiftleft(CAST({lo} AS BIGINT), 42) | shiftleft(CAST({hi} AS BIGINT), 21) | {i})")))
    few = lambda t: F.transform(grouped(F.sort_array(F.flatten(packed(t))), lambda e: _high(e, 21)), lambda r: F.transform(r, lambda e: _low(e, 21)))
    side = lambda t: F.transform(t, lambda x, i: pair(x, lambda lo, hi: structs(lo=lo, hi=hi, i=i)))
    any_ = lambda t: F.transform(grouped(F.sort_array(F.flatten(side(t))), lambda e: F.struct(e["lo"], e["hi"])), lambda r: F.transform(r, lambda e: e["i"]))
    return let(t, lambda t: F.when(_within(t, 21), few(t)).otherwise(any_(t)))


def _meeting(e: Column) -> Column:
    """Of ``edges`` the pairs (f, g) of places, each with the side's first one."""
    return F.flatten(F.transform(e, lambda r: F.transform(F.slice(r, 2, F.size(r) - 1), lambda x: structs(f=r[0], g=x))))


def _signed(t: Column, v: Column) -> Column:
    """Volume by tetrahedra over the mean of all vertices."""

    def about(m: Column) -> Column:
        def one(x: Column) -> Column:
            p = [[x[f"{c}{i}"] - m[c] for c in "xyz"] for i in range(3)]
            (ax, ay, az), (bx, by, bz), (cx, cy, cz) = p
            return ax * (by * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - by * cx)

        return total(t, one) / 6

    return let(structs(**{c: total(v, lambda p, c=c: p[c]) / F.size(v) for c in "xyz"}), about)


def _faced(x: Column, flip: Column) -> Column:
    """A triangle, wound over where ``flip``, with unit normal (zero if degenerate), area and centroid."""
    turned = structs(fid=x["fid"], a=x["a"], b=F.when(flip, x["c"]).otherwise(x["b"]), c=F.when(flip, x["b"]).otherwise(x["c"]), **{f"{c}0": x[f"{c}0"] for c in "xyz"}, **{f"{c}{i}": F.when(flip, x[f"{c}{3 - i}"]).otherwise(x[f"{c}{i}"]) for i in (1, 2) for c in "xyz"})

    def cross(y: Column) -> Column:
        d = lambda c, i: y[f"{c}{i}"] - y[f"{c}0"]
        n = {"nx": d("y", 1) * d("z", 2) - d("z", 1) * d("y", 2), "ny": d("z", 1) * d("x", 2) - d("x", 1) * d("z", 2), "nz": d("x", 1) * d("y", 2) - d("y", 1) * d("x", 2)}
        length = lambda m: F.sqrt(m["nx"] * m["nx"] + m["ny"] * m["ny"] + m["nz"] * m["nz"])
        whole = lambda m: let(length(m), lambda s: structs(**{f: y[f] for f in ("fid", "a", "b", "c", *CORNER)}, **{f"u{c}": m[f"n{c}"] / F.when(s == 0, 1.0).otherwise(s) for c in "xyz"}, area=s / 2, **{f"m{c}": (y[f"{c}0"] + y[f"{c}1"] + y[f"{c}2"]) / 3 for c in "xyz"}))
        return let(structs(**n), whole)

    return let(turned, cross)


def faced(meshes: DataFrame) -> DataFrame:
    """Adds level 1: is_watertight, num_edges, non_manifold_edges, signed_volume, volume, normals_flipped, box; ``t`` wound outwards
    and with normals; ``near``: pairs (f, g) of places of triangles that share a side, each with the side's first one."""
    by_side = let(edges(F.col("t")), lambda e: structs(
        num_edges=F.size(e).cast("bigint"), non_manifold_edges=F.size(F.filter(e, lambda r: F.size(r) != 2)).cast("bigint"),
        near=_meeting(e),
    ))
    out = fixed(put(put(meshes, {"_e": by_side}), {"signed_volume": _signed(F.col("t"), F.col("v"))}))
    out = fixed(put(out, {"num_edges": F.col("_e.num_edges"), "non_manifold_edges": F.col("_e.non_manifold_edges"), "near": F.col("_e.near"), "is_watertight": F.col("_e.non_manifold_edges") == 0}).drop("_e"))
    out = fixed(put(put(out, {"normals_flipped": F.col("is_watertight") & (F.col("signed_volume") < 0) & (F.size("t") >= 4)}), {"volume": F.abs("signed_volume")}))
    out = fixed(put(out, {f"{n}_{c}": f(F.col("v"), lambda p, c=c: p[c]) for c in "xyz" for n, f in (("min", lowest), ("max", highest))}))
    out = fixed(put(out, {f"size_{c}": F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"}))
    return fixed(put(out, {"t": F.transform("t", lambda x: _faced(x, F.col("normals_flipped")))}))


def with_centroid(solids: DataFrame) -> DataFrame:
    """Adds cx, cy, cz: the area-weighted mean of triangle centroids; the plain mean where the area is zero."""
    mean = lambda c: F.coalesce(F.try_divide(total(F.col("t"), lambda x: x[f"m{c}"] * x["area"]), total(F.col("t"), lambda x: x["area"])), total(F.col("t"), lambda x: x[f"m{c}"]) / F.size("t"))
    return put(solids, {f"c{c}": mean(c) for c in "xyz"})


@functions.pandas_udf(ArrayType(IntegerType()))
def closed(n: pd.Series, f: pd.Series, g: pd.Series) -> pd.Series:
    """For each of n nodes the smallest one that it reaches by the pairs (f, g), for a whole batch of graphs: ``components`` in numpy."""
    sizes = n.to_numpy(np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)])
    counts = np.array([len(x) for x in f], np.int64)
    flat = lambda s: np.concatenate([*s, np.zeros(0, np.int64)]).astype(np.int64) + np.repeat(base[:-1], counts)
    u, v, label = flat(f), flat(g), np.arange(base[-1])
    while True:
        a, b = label[u], label[v]
        open_ = a != b
        if not open_.any():
            break
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != (up := label[label])).any():
            label = up
    return pd.Series([label[i:j] - i for i, j in zip(base[:-1], base[1:], strict=True)])


#: Nodes up to which a pair hands its smaller label to all who have the larger one; beyond, all pairs hand on at once, in rounds.
FEW_NODES = 32


def _joined(pairs: Column, nodes: Column) -> Column:
    """Labels of few nodes, pair after pair."""
    merge = lambda a, b: lambda label: F.transform(label, lambda x: F.when(x == F.greatest(a, b), F.least(a, b)).otherwise(x))
    step = lambda label, p: F.when(F.get(label, p["f"]) == F.get(label, p["g"]), label).otherwise(let(structs(a=F.get(label, p["f"]), b=F.get(label, p["g"])), lambda e: merge(e["a"], e["b"])(label)))
    return F.aggregate(pairs, _numbers(nodes), step)


def _rounds(pairs: Column, nodes: Column) -> Column:
    """Labels by rounds: of the labels that a pair holds apart the larger one moves to the least that it meets, then labels move to where
    theirs went. A round sorts the open pairs; each makes labels fewer, as a rule by a half and more."""

    def moved(s: Column) -> Column:
        met = F.transform(s["open"], lambda p: let(structs(a=F.get(s["label"], p["f"]), b=F.get(s["label"], p["g"])), lambda e: _pack(F.greatest(e["a"], e["b"]), F.least(e["a"], e["b"]))))
        least = lambda e: F.transform(F.filter(e, lambda x, i: (i == 0) | (_high(x, 32) != _high(F.get(e, i - 1), 32))), lambda x: _low(x, 32))
        up = let(F.sort_array(F.concat(met, F.transform(_numbers(nodes), lambda i: _pack(i, i)))), least)
        for _ in range(3):
            up = let(up, lambda u: F.transform(u, lambda x: F.get(u, x)))
        label = let(up, lambda u: F.transform(s["label"], lambda x: F.get(u, x)))
        return let(label, lambda m: structs(label=m, open=_apart(s["open"], m)))

    begin = structs(label=_numbers(nodes), open=_apart(pairs, _numbers(nodes)))
    return let(begin, lambda s: F.aggregate(_numbers(nodes), s, lambda s, _: F.when(F.size(s["open"]) == 0, s).otherwise(moved(s))))["label"]


def _apart(pairs: Column, label: Column) -> Column:
    return let(label, lambda m: F.filter(pairs, lambda p: F.get(m, p["f"]) != F.get(m, p["g"])))


def _numbers(n: Column) -> Column:
    """0 .. n - 1 of n above 0."""
    return F.sequence(F.lit(0), n - 1)


def _pack(high: Column, low: Column) -> Column:
    return Column(f"(shiftleft(CAST({high} AS BIGINT), 32) | {low})")


def components(pairs: Column, nodes: Column) -> functions.Column:
    """By node (0 .. nodes - 1) the smallest one of its component, of pairs (f, g) of nodes; an expression over the row, without Python."""
    both = lambda e: F.when(e["n"] <= 0, F.expr("CAST(array() AS array<int>)")).when(e["n"] <= FEW_NODES, _joined(e["p"], e["n"])).otherwise(_rounds(e["p"], e["n"]))
    return functions.expr(str(let(structs(p=Column(str(pairs)), n=Column(str(nodes))), both)))


def coplanar(t: Column, near: Column, degrees: float = 5.0) -> Column:
    """Of pairs of places those whose unit normals differ by less than ``degrees``."""
    dot = lambda p, q: p["ux"] * q["ux"] + p["uy"] * q["uy"] + p["uz"] * q["uz"]
    return let(t, lambda t: F.filter(near, lambda e: F.acos(F.greatest(F.least(dot(F.get(t, e["f"]), F.get(t, e["g"])), F.lit(1.0)), F.lit(-1.0))) < F.radians(F.lit(degrees))))


def labelled(solids: DataFrame, degrees: float = 5.0) -> DataFrame:
    """Adds ``label``: by place the place of the first triangle of its coplanar cluster."""
    return fixed(put(put(small_batches(solids), {"_pairs": coplanar(F.col("t"), F.col("near"), degrees)}), {"label": components(F.col("_pairs"), F.size("t"))}).drop("_pairs"))


def _properties(members: Column, place: Column) -> Column:
    """A group of triangles: unit normal and centroid by area, area, number; its first place in ``t`` and its members."""
    zero = structs(area=F.lit(0.0), **{f"{p}{c}": F.lit(0.0) for p in "np" for c in "xyz"})
    step = lambda s, x: structs(area=s["area"] + x["area"], **{f"n{c}": s[f"n{c}"] + x[f"u{c}"] * x["area"] for c in "xyz"}, **{f"p{c}": s[f"p{c}"] + x[f"m{c}"] * x["area"] for c in "xyz"})

    def done(s: Column) -> Column:
        return let(F.sqrt(s["nx"] * s["nx"] + s["ny"] * s["ny"] + s["nz"] * s["nz"]), lambda n: structs(
            group_id=members[0]["fid"], area=s["area"], num_triangles=F.size(members).cast("bigint"), **{f"p{c}": F.try_divide(s[f"p{c}"], s["area"]) for c in "xyz"},
            **{f"g{c}": s[f"n{c}"] / F.when(n == 0, 1.0).otherwise(n) for c in "xyz"}, place=place, members=members,
        ))

    return let(F.aggregate(members, zero, step), done)


def with_groups(solids: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``groups``: clusters of triangles (group_id: their first fid), in the order of their ids."""
    return fixed(put(solids, {"groups": gathered(F.col(label), lambda place, at: let(F.transform(at, lambda i: F.get("t", i)), lambda x: _properties(x, place)))}))


def with_axis(solids: DataFrame) -> DataFrame:
    """Adds ``ax``, ``ay``: main direction in plan of the area-weighted triangle centroids; the longer box side if round.

    The larger component is positive.
    """

    def spread(m: Column) -> Column:
        w = lambda f: F.try_divide(total(F.col("t"), f), m["w"])
        return structs(xx=w(lambda x: x["area"] * (x["mx"] - m["x"]) * (x["mx"] - m["x"])), xy=w(lambda x: x["area"] * (x["mx"] - m["x"]) * (x["my"] - m["y"])), yy=w(lambda x: x["area"] * (x["my"] - m["y"]) * (x["my"] - m["y"])))

    area = total(F.col("t"), lambda x: x["area"])
    mean = let(area, lambda w: structs(w=w, x=F.try_divide(total(F.col("t"), lambda x: x["area"] * x["mx"]), w), y=F.try_divide(total(F.col("t"), lambda x: x["area"] * x["my"]), w)))
    own = lambda c: (highest(F.col("t"), lambda x: F.greatest(*(x[f"{c}{i}"] for i in range(3)))) - lowest(F.col("t"), lambda x: F.least(*(x[f"{c}{i}"] for i in range(3)))))

    def vector(s: Column) -> Column:
        half = (s["xx"] + s["yy"]) / 2
        d = F.sqrt(F.pow((s["xx"] - s["yy"]) / 2, F.lit(2)) + s["xy"] * s["xy"])
        return let(structs(big=half + d, small=half - d, xx=s["xx"], xy=s["xy"], yy=s["yy"]), lambda q: let(
            # of the two forms of the eigenvector the one whose entries don't cancel
            structs(x=F.when(q["xx"] >= q["yy"], q["big"] - q["yy"]).otherwise(q["xy"]), y=F.when(q["xx"] >= q["yy"], q["xy"]).otherwise(q["big"] - q["xx"])),
            lambda e: let(F.sqrt(e["x"] * e["x"] + e["y"] * e["y"]), lambda n: let(
                structs(round=(q["big"] / F.greatest(q["small"], F.lit(1e-12)) < 2) | (n == 0), sign=F.when(F.when(F.abs(e["x"]) >= F.abs(e["y"]), e["x"]).otherwise(e["y"]) < 0, -1.0).otherwise(1.0), wide=own("x") >= own("y")),
                lambda r: structs(ax=F.when(r["round"], r["wide"].cast("double")).otherwise(r["sign"] * e["x"] / n), ay=F.when(r["round"], (~r["wide"]).cast("double")).otherwise(r["sign"] * e["y"] / n)),
            )),
        ))

    return put(put(solids, {"_axis": let(let(mean, spread), vector)}), {"ax": F.col("_axis.ax"), "ay": F.col("_axis.ay")}).drop("_axis")


def largest_body(solids: DataFrame) -> DataFrame:
    """Of meshes of several bodies the triangles of the one of most area, the first of equals; adds ``num_bodies``."""
    bodies = gathered(F.col("_body"), lambda place, at: let(F.transform(at, lambda i: F.get("t", i)), lambda x: structs(area=F.round(total(x, lambda m: m["area"]), 6), first=-place, t=x)))
    out = fixed(put(fixed(put(small_batches(solids), {"_body": components(F.col("near"), F.size("t"))})), {"num_bodies": F.size(F.array_distinct("_body"))}))
    out = fixed(put(out, {"t": F.when(F.col("num_bodies") > 1, let(F.array_max(bodies), lambda b: b["t"])).otherwise(F.col("t"))}))
    pairs = _meeting(edges(F.col("t")))
    return fixed(put(out, {"near": F.when(F.col("num_bodies") > 1, pairs).otherwise(F.col("near"))}).drop("_body"))


def _corners(t: Column) -> Column:
    return F.flatten(F.transform(t, lambda x: F.array(*(structs(vid=x[v], **{c: x[f"{c}{i}"] for c in "xyz"}) for i, v in enumerate("abc")))))


def corners(members: Column) -> Column:
    """Distinct vertices (vid, x, y, z) of triangles."""
    packed = lambda e: F.sort_array(F.transform(e, lambda p, i: Column(f"(shiftleft(CAST({p['vid']} AS BIGINT), 31) | {i})")))
    first = lambda s: F.filter(s, lambda v, k: (k == 0) | (_high(v, 31) != _high(F.get(s, k - 1), 31)))
    few = lambda e: F.transform(let(packed(e), first), lambda v: F.get(e, _low(v, 31)))
    any_ = lambda e: F.transform(grouped(F.sort_array(e), lambda p: p["vid"]), lambda r: r[0])
    return let(members, lambda m: let(_corners(m), lambda e: F.when(_within(m, 31), few(e)).otherwise(any_(e))))


def topmost(rows: Column, z: Callable[[Column], Column]) -> Column:
    """Of rows the upper ones, where the largest gap of their heights exceeds a millimetre and the spread on both sides of it."""

    def split(s: Column) -> Column:
        gaps = F.transform(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), lambda i: F.get(s, i) - F.get(s, i - 1))
        at = let(gaps, lambda g: F.array_position(g, F.array_max(g))).cast("int")
        return let(at, lambda k: structs(gap=F.get(s, k) - F.get(s, k - 1), spread=F.greatest(F.get(s, k - 1) - F.get(s, F.lit(0)), F.get(s, F.size(s) - 1) - F.get(s, k)), mid=(F.get(s, k) + F.get(s, k - 1)) / 2))

    def upper(rows: Column) -> Column:
        cut = let(F.sort_array(F.transform(rows, lambda r: z(r))), split)
        return let(cut, lambda c: F.when(F.coalesce(c["gap"] > F.greatest(c["spread"], F.lit(1e-3)), F.lit(False)), F.filter(rows, lambda r: z(r) > c["mid"])).otherwise(rows))

    return let(rows, lambda r: F.when(F.size(r) > 1, upper(r)).otherwise(r))


def _plane_axis(xx: Column, xy: Column, yy: Column) -> Column:
    """Unit direction (x, y) of most spread, larger component positive, and whether both spreads are alike."""
    d = F.sqrt(F.pow((xx - yy) / 2, F.lit(2)) + xy * xy)
    big, small = (xx + yy) / 2 + d, (xx + yy) / 2 - d
    form = structs(x=F.when(xx >= yy, big - yy).otherwise(xy), y=F.when(xx >= yy, xy).otherwise(big - xx), round=big / F.greatest(small, F.lit(1e-12)) < 2)
    return let(form, lambda e: let(F.sqrt(e["x"] * e["x"] + e["y"] * e["y"]), lambda n: let(
        F.when(F.when(F.abs(e["x"]) >= F.abs(e["y"]), e["x"]).otherwise(e["y"]) < 0, -1.0).otherwise(1.0), lambda s: structs(x=F.when(n == 0, 1.0).otherwise(s * e["x"] / n), y=F.when(n == 0, 0.0).otherwise(s * e["y"] / n), round=e["round"] | (n == 0))
    )))


def _moments(points: Column) -> Column:
    """Mean and spread in plan of points."""
    mean = structs(x=total(points, lambda p: p["x"]) / F.size(points), y=total(points, lambda p: p["y"]) / F.size(points))
    return let(mean, lambda m: structs(x=m["x"], y=m["y"], **{n: total(points, lambda p, a=a, b=b: (p[a] - m[a]) * (p[b] - m[b])) / F.size(points) for n, a, b in (("xx", "x", "x"), ("xy", "x", "y"), ("yy", "y", "y"))}))


def _straight(v: Column) -> Column:
    """Centreline of two points along the vertices' own axis."""

    def along(m: Column) -> Column:
        wide = highest(v, lambda p: p["x"]) - lowest(v, lambda p: p["x"]) >= highest(v, lambda p: p["y"]) - lowest(v, lambda p: p["y"])
        axis = let(_plane_axis(m["xx"], m["xy"], m["yy"]), lambda a: structs(x=F.when(a["round"], wide.cast("double")).otherwise(a["x"]), y=F.when(a["round"], (~wide).cast("double")).otherwise(a["y"])))
        span = lambda a: let(F.transform(v, lambda p: (p["x"] - m["x"]) * a["x"] + (p["y"] - m["y"]) * a["y"]), lambda t: structs(lo=F.array_min(t), hi=F.array_max(t)))
        return let(axis, lambda a: let(span(a), lambda s: structs(
            line=F.array(*(structs(px=m["x"] + s[e] * a["x"], py=m["y"] + s[e] * a["y"], tx=a["x"], ty=a["y"], nx=a["y"], ny=-a["x"], w=F.lit(0.0)) for e in ("lo", "hi"))),
            is_curved=F.lit(False), length=s["hi"] - s["lo"], max_deviation=F.lit(0.0), median_width=F.lit(None).cast("double"), ax=a["x"], ay=a["y"],
        )))

    return let(_moments(v), along)


def _step(points: Column, i: Column) -> Column:
    """Unit central difference (x, y) at point ``i``, one-sided at the ends; zero where points coincide."""
    a, b = F.get(points, F.greatest(i - 1, F.lit(0))), F.get(points, F.least(i + 1, F.size(points) - 1))
    return let(structs(x=b["x"] - a["x"], y=b["y"] - a["y"]), lambda d: let(F.sqrt(d["x"] * d["x"] + d["y"] * d["y"]), lambda n: structs(x=F.when(n > 1e-12, d["x"] / n).otherwise(0.0), y=F.when(n > 1e-12, d["y"] / n).otherwise(0.0))))


def segments(points: Column) -> Column:
    """Unit direction and length of each segment of a polyline (x, y)."""
    pair = lambda points, i: let(structs(x=F.get(points, i)["x"] - F.get(points, i - 1)["x"], y=F.get(points, i)["y"] - F.get(points, i - 1)["y"]), lambda d: let(F.sqrt(d["x"] * d["x"] + d["y"] * d["y"]), lambda n: structs(x=d["x"] / F.when(n == 0, 1.0).otherwise(n), y=d["y"] / F.when(n == 0, 1.0).otherwise(n), n=n)))
    return let(points, lambda p: F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), lambda i: pair(p, i))).otherwise(F.array().cast("array<struct<x:double,y:double,n:double>>")))


def turns(segs: Column) -> Column:
    """Angles between segments that follow one another, in radians."""
    turn = lambda segs, i: F.acos(F.greatest(F.least(F.get(segs, i)["x"] * F.get(segs, i - 1)["x"] + F.get(segs, i)["y"] * F.get(segs, i - 1)["y"], F.lit(1.0)), F.lit(-1.0)))
    return let(segs, lambda s: F.when(F.size(s) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), lambda i: turn(s, i))).otherwise(F.array().cast("array<double>")))


def bends(points: Column) -> Column:
    """Whether a polyline turns beyond its noise: the whole turn exceeds three deviations (by the median absolute one) times
    the root of the number of steps, and no step holds half of it."""

    def test(a: Column) -> Column:
        mid = let(median(a), lambda m: structs(m=m, mad=median(F.transform(a, lambda x: F.abs(x - m)))))
        sigma = let(mid, lambda q: F.when(q["mad"] > 1e-10, q["mad"] / 0.6745).otherwise(F.greatest(q["m"] / 3, F.lit(1e-6))))
        return let(structs(all=total(a, lambda x: x), n=F.size(a)), lambda s: (s["n"] >= 2) & (s["all"] / s["n"] > 1e-10) & (s["all"] > 3 * sigma * F.sqrt(s["n"])) & (F.try_divide(F.array_max(a), s["all"]) < 0.5))

    angles = F.transform(turns(F.filter(segments(points), lambda s: s["n"] > 1e-12)), lambda x: F.degrees(x))
    return F.coalesce(F.when(F.size(points) >= 4, let(angles, test)), F.lit(False))


def _sliced(points: Column, slices: int, spacing: float) -> Column:
    """Slices across the main direction of the crown's points: (points (x, y, w), dt)."""

    def cut(m: Column, a: Column) -> Column:
        at = F.transform(points, lambda p: structs(t=(p["x"] - m["x"]) * a["x"] + (p["y"] - m["y"]) * a["y"], s=-(p["x"] - m["x"]) * a["y"] + (p["y"] - m["y"]) * a["x"]))

        def rows(q: Column, r: Column) -> Column:
            near = lambda p: let((p["t"] - r["lo"]) / r["step"], lambda u: F.filter(F.sequence(F.greatest(F.floor(u - 0.6).cast("int"), F.lit(0)), F.least(F.ceil(u + 0.6).cast("int"), r["n"] - 1)), lambda i: F.abs(p["t"] - (r["lo"] + i * r["step"])) < r["dt"]))
            by_slice = grouped(F.sort_array(F.flatten(F.transform(q, lambda p: F.transform(near(p), lambda i: structs(i=i, s=p["s"]))))), lambda p: p["i"])
            full = F.filter(by_slice, lambda g: F.size(g) >= 2)  # sorted by i, then s
            mid = lambda g: let(structs(t=r["lo"] + g[0]["i"] * r["step"], lo=g[0]["s"], hi=F.element_at(g, -1)["s"]), lambda e: structs(x=m["x"] + e["t"] * a["x"] - (e["lo"] + e["hi"]) / 2 * a["y"], y=m["y"] + e["t"] * a["y"] + (e["lo"] + e["hi"]) / 2 * a["x"], w=e["hi"] - e["lo"]))
            return structs(points=F.transform(full, mid), dt=r["dt"])

        def ranged(q: Column) -> Column:
            span = structs(lo=lowest(q, lambda p: p["t"]), hi=highest(q, lambda p: p["t"]))
            count = lambda s: F.greatest(F.lit(slices), F.floor((s["hi"] - s["lo"]) / spacing).cast("int") + 1)
            grid = lambda s: let(count(s), lambda n: structs(lo=s["lo"], n=n, step=(s["hi"] - s["lo"]) / (n - 1), dt=(s["hi"] - s["lo"]) / (n - 1) * 0.6))
            return let(let(span, grid), lambda r: F.when(r["step"] * (r["n"] - 1) >= 1e-6, rows(q, r)))

        return let(at, ranged)

    return let(_moments(points), lambda m: let(_plane_axis(m["xx"], m["xy"], m["yy"]), lambda a: cut(m, a)))


def _refined(line: Column, points: Column, dt: Column) -> Column:
    """One pass: each point to the middle of the crown across its own tangent."""

    def one(p: Column, i: Column) -> Column:
        def across(d: Column) -> Column:
            near = F.filter(points, lambda q: F.abs((q["x"] - p["x"]) * d["x"] + (q["y"] - p["y"]) * d["y"]) < dt)
            side = let(F.transform(near, lambda q: -(q["x"] - p["x"]) * d["y"] + (q["y"] - p["y"]) * d["x"]), lambda s: structs(n=F.size(s), lo=F.array_min(s), hi=F.array_max(s)))
            moved = lambda s: structs(x=p["x"] - (s["lo"] + s["hi"]) / 2 * d["y"], y=p["y"] + (s["lo"] + s["hi"]) / 2 * d["x"], w=s["hi"] - s["lo"])
            return let(side, lambda s: F.when((s["n"] >= 2) & ((d["x"] != 0) | (d["y"] != 0)), moved(s)).otherwise(p))

        return let(_step(line, i), across)

    return F.transform(line, one)


def with_centreline(solids: DataFrame, horizontal: float = 45.0, slices: int = 20, spacing: float = 0.3) -> DataFrame:
    """Adds ``line`` (px, py, tx, ty, nx, ny, w), is_curved, wall_length_m, max_deviation, ``local`` and the axis ax, ay.

    The line runs through the middle of the topmost crown, slice by slice; walls whose crown fills less than three slices
    get two points along their vertices' axis. ``local``: measure in the frames along the line.
    """
    crowns = F.filter("groups", lambda g: g["gz"] > F.cos(F.radians(F.lit(horizontal))))
    high = F.transform(crowns, lambda g: let(corners(g["members"]), lambda c: structs(z=total(c, lambda p: p["z"]) / F.size(c), members=g["members"])))
    crown = corners(F.flatten(F.transform(topmost(high, lambda r: r["z"]), lambda r: r["members"])))
    out = fixed(put(with_axis(solids), {"_crown": crown}))
    out = fixed(put(out, {"_cut": F.when(F.size("_crown") >= 3, _sliced(F.col("_crown"), slices, spacing))}))
    usable = F.size("_cut.points") >= 3

    def drawn(p: Column) -> Column:
        chord = let(structs(x=F.element_at(p, -1)["x"] - p[0]["x"], y=F.element_at(p, -1)["y"] - p[0]["y"]), lambda c: structs(x=c["x"], y=c["y"], n=F.sqrt(c["x"] * c["x"] + c["y"] * c["y"])))
        off = let(chord, lambda c: structs(n=c["n"], far=highest(p, lambda q: F.abs(-(q["x"] - p[0]["x"]) * c["y"] + (q["y"] - p[0]["y"]) * c["x"]) / F.when(c["n"] == 0, 1.0).otherwise(c["n"]))))
        return let(structs(off=off, bent=bends(p)), lambda s: F.when(s["off"]["n"] >= 1e-6, structs(points=F.when(s["bent"], _refined(p, F.col("_crown"), F.col("_cut.dt"))).otherwise(p), is_curved=s["bent"], max_deviation=s["off"]["far"])))

    def whole(d: Column) -> Column:
        p = d["points"]
        frames = F.transform(p, lambda q, i: let(_step(p, i), lambda t: structs(px=q["x"], py=q["y"], tx=t["x"], ty=t["y"], nx=-t["y"], ny=t["x"], w=q["w"])))
        width = let(F.filter(F.transform(p, lambda q: q["w"]), lambda w: w > 1e-6), median)
        return structs(line=frames, is_curved=d["is_curved"], length=total(segments(p), lambda s: s["n"]), max_deviation=d["max_deviation"], median_width=width, ax=F.col("ax"), ay=F.col("ay"))

    out = fixed(put(out, {"_drawn": F.when(usable, let(F.col("_cut.points"), drawn))}))
    out = fixed(put(out, {"_own": F.when(F.col("_drawn").isNotNull(), whole(F.col("_drawn"))).otherwise(_straight(F.col("v")))}))
    out = fixed(put(out, {"line": F.col("_own.line"), "is_curved": F.col("_own.is_curved"), "wall_length_m": F.round("_own.length", 4), "max_deviation": F.col("_own.max_deviation"), "median_width": F.col("_own.median_width"), "ax": F.col("_own.ax"), "ay": F.col("_own.ay")}))
    local = F.col("is_curved") | F.coalesce(F.col("max_deviation") / F.col("median_width") > 1, F.col("max_deviation") > 0)
    return fixed(put(out, {"local": local}).drop("_crown", "_cut", "_drawn", "_own"))


def frame(x: Column, y: Column, line: Column, local: Column) -> Column:
    """Frame at a place: the nearest one of the line, the first of equals; the first one of a straight line of two points."""
    near = F.array_min(F.transform(line, lambda f, i: structs(d=(f["px"] - x) * (f["px"] - x) + (f["py"] - y) * (f["py"] - y), i=i)))
    return F.when((F.size(line) <= 2) & ~local, line[0]).otherwise(F.get(line, let(near, lambda n: n["i"])))


def from_polyline(lines: DataFrame, points: str = "points") -> DataFrame:
    """A centreline from given points (array of x, y): adds ``line``, is_curved (four points or more that turn by over ten
    degrees) and wall_length_m; lines of less than two points are dropped."""
    p = F.col(points)
    out = lines.where(f"size({points}) >= 2")
    frames = F.transform(p, lambda q, i: let(_step(p, i), lambda t: structs(px=q["x"], py=q["y"], tx=t["x"], ty=t["y"], nx=-t["y"], ny=t["x"], w=F.lit(0.0))))
    turn = total(turns(F.filter(segments(p), lambda s: s["n"] > 1e-12)), lambda a: F.degrees(a))
    return put(out, {"line": frames, "is_curved": (F.size(points) >= 4) & (turn > 10), "wall_length_m": F.round(total(segments(p), lambda s: s["n"]), 4)})
