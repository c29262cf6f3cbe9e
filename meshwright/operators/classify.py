"""L2: surfaces of elements by category, and what the element is. A row an element (``solid``)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import solid
from . import text as F
from .mesh import KEY
from .solid import let, structs, total
from .spread import small_batches
from .text import Sql as Column
from .text import put

CATEGORIES = ("crown", "foundation", "front", "back", "end_left", "end_right", "unclassified")


def _kinds(horizontal: float, lateral: float, x: dict[str, Column]) -> Column:
    """Groups with ``kind``: a category, or the side + or - of the frame's normal, and the distance along it."""
    groups, line, local = F.col("groups"), F.col("line"), F.col("local")

    def of(span: Column) -> Column:
        def one(g: Column) -> Column:
            flat = F.sqrt(g["gx"] * g["gx"] + g["gy"] * g["gy"])

            def upright(f: Column) -> Column:
                toward = (g["gx"] * f["tx"] + g["gy"] * f["ty"]) / flat
                place = g["px"] * x["ax"] + g["py"] * x["ay"]
                at_end = F.least(place - span["lo"], span["hi"] - place) < span["reach"]
                side = g["gx"] * f["nx"] + g["gy"] * f["ny"]
                end = F.when(~at_end, "unclassified").when(toward > 0, "end_right").otherwise("end_left")
                return F.when(F.abs(toward) > F.cos(F.radians(F.lit(lateral))), end).otherwise(F.when(side >= 0, "+").otherwise("-"))

            vertical = F.when(flat < 1e-10, "unclassified").otherwise(let(solid.frame(g["px"], g["py"], line, local), upright))
            return structs(g=g, kind=F.when(F.abs(g["gz"]) > F.cos(F.radians(F.lit(horizontal))), F.when(g["gz"] > 0, "crown").otherwise("foundation")).otherwise(vertical))

        return F.transform(groups, one)

    places = F.transform(groups, lambda g: g["px"] * x["ax"] + g["py"] * x["ay"])
    sizes = [solid.highest(groups, lambda g, c=c: g[f"p{c}"]) - solid.lowest(groups, lambda g, c=c: g[f"p{c}"]) for c in "xyz"]
    narrow = F.least(*(F.when(s > 1e-6, s) for s in sizes))
    span = let(places, lambda p: structs(lo=F.array_min(p), hi=F.array_max(p), reach=F.coalesce(F.col("median_width"), narrow, F.greatest((F.array_max(p) - F.array_min(p)) * 0.1, F.lit(0.01)))))
    return let(span, of)


def with_categories(solids: DataFrame, horizontal: float = 45.0, lateral: float = 45.0) -> DataFrame:
    """Gives ``groups`` a category, adds the front/back ``asymmetry``.

    Level faces are crown or foundation. Faces along the line are ends where they stand at one of its extremities. The
    larger of the two remaining sides is the front; of equal ones the one against the frames' normals.
    """
    out = solid.fixed(put(solids, {"_kinds": _kinds(horizontal, lateral, {"ax": F.col("ax"), "ay": F.col("ay")})}))
    side = lambda s: total(F.filter("_kinds", lambda k: k["kind"] == s), lambda k: k["g"]["area"])
    out = solid.fixed(put(put(out, {"_sides": solid.held(plus=side("+"), minus=side("-"))}), {"asymmetry": F.coalesce(F.try_divide(F.abs(F.col("_sides.plus") - F.col("_sides.minus")), F.col("_sides.plus") + F.col("_sides.minus")), F.lit(0.0))}))
    front = F.when((F.col("asymmetry") > 1e-6) & (F.col("_sides.plus") > F.col("_sides.minus")), "+").otherwise("-")
    names = lambda k: F.when(k["kind"].isin("+", "-"), F.when(k["kind"] == F.col("_front"), "front").otherwise("back")).otherwise(k["kind"])
    fields = ("group_id", "area", "num_triangles", "px", "py", "pz", "gx", "gy", "gz", "place", "members")
    out = solid.fixed(put(put(out, {"_front": front}), {"groups": F.transform("_kinds", lambda k: structs(**{f: k["g"][f] for f in fields}, category=names(k)))}))
    return out.drop("_kinds", "_sides", "_front")


def merged(solids: DataFrame) -> DataFrame:
    """Neighbouring groups of one category become one: normals and centroids by area, the smallest group_id."""
    by_place = F.sort_array(F.flatten(F.transform("groups", lambda g: F.transform(g["members"], lambda m: structs(fid=m["fid"], category=g["category"])))))
    same = let(by_place, lambda p: F.filter("near", lambda e: F.get(p, e["f"])["category"] == F.get(p, e["g"])["category"]))
    out = solid.fixed(put(solid.fixed(put(small_batches(solids), {"_same": same})), {"_parts": solid.components(F.col("_same"), F.size("t"))}))
    part = F.transform("groups", lambda g: F.get(F.col("_parts"), g["place"]))
    zero = structs(area=F.lit(0.0), n=F.lit(0).cast("bigint"), **{f"{p}{c}": F.lit(0.0) for p in "np" for c in "xyz"})
    step = lambda s, r: structs(area=s["area"] + r["area"], n=s["n"] + r["num_triangles"], **{f"n{c}": s[f"n{c}"] + r[f"g{c}"] * r["area"] for c in "xyz"}, **{f"p{c}": s[f"p{c}"] + r[f"p{c}"] * r["area"] for c in "xyz"})

    def one(r: Column) -> Column:
        def done(s: Column) -> Column:
            return let(F.sqrt(s["nx"] * s["nx"] + s["ny"] * s["ny"] + s["nz"] * s["nz"]), lambda n: structs(
                group_id=r[0]["group_id"], area=s["area"], num_triangles=s["n"], **{f"p{c}": F.try_divide(s[f"p{c}"], s["area"]) for c in "xyz"}, **{f"g{c}": s[f"n{c}"] / F.when(n == 0, 1.0).otherwise(n) for c in "xyz"},
                place=r[0]["place"], members=F.when(F.size(r) == 1, r[0]["members"]).otherwise(F.sort_array(F.flatten(F.transform(r, lambda q: q["members"])))), category=r[0]["category"],
            ))

        return let(F.aggregate(r, zero, step), done)

    return solid.fixed(put(out, {"groups": solid.gathered(part, lambda _, at: let(F.transform(at, lambda k: F.get("groups", k)), one))}).drop("_same", "_parts"))


def classified(meshes: DataFrame, horizontal: float = 45.0, lateral: float = 45.0, coplanar: float = 5.0) -> DataFrame:
    """All of level 2 of rows (key, t, v): largest body, clusters, centreline, categories, merging."""
    bodies = solid.largest_body(solid.faced(meshes))
    out = solid.with_centreline(solid.with_groups(solid.labelled(bodies, coplanar)), horizontal)
    return with_summary(merged(with_categories(out, horizontal, lateral)))


def with_summary(solids: DataFrame) -> DataFrame:
    """Adds count and area of each category."""
    pick = lambda c: F.filter("groups", lambda g: g["category"] == c)
    of = {c: pick(c) for c in CATEGORIES}
    return solid.fixed(put(solids, {f"{c}_count": F.size(g).cast("bigint") for c, g in of.items()} | {f"{c}_area": total(g, lambda x: x["area"]) for c, g in of.items()}))


def explained(groups: DataFrame, horizontal: float = 45.0) -> DataFrame:
    """Adds to rows of groups ``reason``: why the group has its category, in words."""
    tilt = F.degrees(F.acos(F.greatest(F.least("gz", F.lit(1.0)), F.lit(-1.0))))
    why = F.when(F.col("category") == "crown", F.format_string("faces up: normal %.1f degrees from vertical, limit %.0f", tilt, F.lit(horizontal)))
    why = why.when(F.col("category") == "foundation", F.format_string("faces down: normal %.1f degrees from vertical, limit %.0f", tilt, F.lit(180 - horizontal)))
    why = why.when(F.col("category").isin("end_left", "end_right"), F.lit("upright, faces along the line at one of its ends"))
    why = why.when(F.col("category") == "front", F.format_string("upright, faces across the line, on the side of more area (asymmetry %.4f)", "asymmetry"))
    why = why.when(F.col("category") == "back", F.format_string("upright, faces across the line, on the side of less area (asymmetry %.4f)", "asymmetry"))
    return put(groups, {"reason": why.otherwise(F.lit("no direction in plan, or faces along the line away from its ends"))})


def describe(solids: DataFrame, key: str = KEY) -> DataFrame:
    """Adds is_wall_like, element_role and confidence, by the category summary and the box."""
    s = put(put(solids, {f"_{n}": F.round(F.col(f"size_{c}"), 3) for n, c in (("x", "x"), ("y", "y"), ("z", "z"))}), {"_max": F.greatest("_x", "_y"), "_min": F.least("_x", "_y")})
    s = put(s, {"_aspect": F.expr("_max / greatest(_min, 1e-6)"), "_vert": F.expr("front_area + back_area"), "_hor": F.expr("crown_area + foundation_area")})
    found = {c: F.col(f"{c}_count") > 0 for c in ("crown", "foundation", "front", "back")}
    flat = "(size_z < 0.05 * greatest(size_x, size_y) AND size_z < 0.5 * least(size_x, size_y))"
    low = "(greatest(size_x, size_y) / greatest(least(size_x, size_y), 1e-6) < 1.5 AND size_z < 0.5 * greatest(size_x, size_y))"
    s = put(s, {"is_wall_like": (F.expr(f"NOT ({low} OR {flat})") & (F.size("v") >= 4)) | (found["crown"] & found["foundation"] & (found["front"] | found["back"]) & F.expr("_vert > 0.3 * _hor"))})
    s = put(s, {"element_role": F.expr(
        "CASE WHEN _z < 0.05 * _max AND _z < 0.5 * _min THEN 'slab' WHEN _z < _min / 2 AND _hor > 2 * _vert THEN 'foundation' WHEN _aspect < 2 AND _z > 0.8 * _max THEN 'column' "
        "WHEN _z < 1.5 AND _min < 0.5 AND _aspect > 3 THEN 'parapet' WHEN _aspect > 2 AND _vert > 0.3 * _hor THEN 'wall_stem' WHEN is_wall_like THEN 'wall_stem' ELSE 'unknown' END"
    )})
    pair = lambda a, b: F.when(found[a] & found[b], 0.25).when(found[a] | found[b], 0.10).otherwise(0.0)
    every = " + ".join(f"{c}_area" for c in CATEGORIES)
    score = pair("crown", "foundation") + pair("front", "back") + 0.2 * F.expr(f"1 - coalesce(try_divide(unclassified_area, {every}), 0D)")
    score = score + F.when(F.col("is_wall_like"), 0.15).otherwise(0.0) + F.expr("CASE WHEN asymmetry > 0.05 THEN 0.15D WHEN asymmetry > 0.01 THEN 0.08D ELSE 0D END")
    return put(s, {"confidence": F.round(F.least(score, F.lit(1.0)), 3)}).drop("_x", "_y", "_z", "_max", "_min", "_aspect", "_vert", "_hor")
