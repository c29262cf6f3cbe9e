"""L3 and enrichments: measurements of walls by category of surface, a row an element; missing surfaces give nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions

from . import classify, solid, terrain
from . import text as F
from .mesh import KEY
from .solid import corners, highest, let, lowest, median, percentile, structs, total
from .text import Sql as Column
from .text import put


def of(category: str, groups: str = "groups") -> Column:
    return F.filter(groups, lambda g: g["category"] == category)


def members(groups: Column) -> Column:
    return F.flatten(F.transform(groups, lambda g: g["members"]))


def slice_tolerance(line: Column) -> Column:
    """0.6 of the median spacing of a line's points; half a metre for a single point."""
    xy = F.transform(line, lambda f: structs(x=f["px"], y=f["py"]))
    return F.when(F.size(line) > 1, median(F.transform(solid.segments(xy), lambda s: s["n"])) * 0.6).otherwise(0.5)


def _across(p: Column) -> Column:
    return p["x"] * F.col("ay") - p["y"] * F.col("ax")


def _slices(points: Column, value) -> Column:
    """``value`` of the points near each frame of the line (at least two of them), nulls left out."""
    near = lambda f: F.filter(points, lambda p: F.abs((p["x"] - f["px"]) * f["tx"] + (p["y"] - f["py"]) * f["ty"]) < F.col("_tolerance"))
    each = F.transform("line", lambda f: F.when((F.abs(f["tx"]) > F.col("_eps")) | (F.abs(f["ty"]) > F.col("_eps")), let(near(f), lambda q: value(q, f))))
    return F.filter(each, lambda w: w.isNotNull())


def _extent(points: Column, of_) -> Column:
    return let(F.transform(points, of_), lambda s: F.array_max(s) - F.array_min(s))


def _width(name: str, tilt: Column) -> tuple[Column, Column]:
    """Extent across the axis over ``tilt``, and widths slice by slice where the wall is measured in local frames."""
    local = _slices(F.col(name), lambda q, f: F.when(F.size(q) >= 2, let(_extent(q, lambda p: p["x"] * f["nx"] + p["y"] * f["ny"]), lambda w: F.when(w > F.col("_eps"), w * 1000))))
    return F.try_divide(_extent(F.col(name), _across), tilt) * 1000, F.when(F.col("local"), F.sort_array(local))


def with_level3(solids: DataFrame) -> DataFrame:
    """Crown, foundation, thickness, inclination, slope, height, length and their uncertainty.

    Curved walls and walls off their chord are measured slice by slice along the line; a width is then the tenth
    percentile of the slices'. Without a usable slice the whole extent counts.
    """
    mean = lambda g, e: F.try_divide(total(g, lambda x: e(x) * x["area"]), total(g, lambda x: x["area"]))
    out = solid.fixed(put(solids, {"_crown": solid.topmost(of("crown"), lambda g: g["pz"]), "_eps": F.sqrt(sum(F.col(f"size_{c}") * F.col(f"size_{c}") for c in "xyz")) * 1e-8, "_tolerance": slice_tolerance(F.col("line"))}))
    out = solid.fixed(put(out, {"_crown_p": corners(members(F.col("_crown"))), "_foundation_p": corners(members(of("foundation"))), "_front_p": corners(members(of("front"))), "_back_p": corners(members(of("back")))}))
    tilt = mean(F.col("_crown"), lambda g: F.abs(g["gz"]))
    whole, sliced = _width("_crown_p", tilt)
    wide, wide_sliced = _width("_foundation_p", F.lit(1.0))
    out = solid.fixed(put(out, {"_crown_w": F.when(F.size("_crown") > 0, whole), "_crown_s": sliced, "_foundation_w": F.when(F.size(of("foundation")) > 0, wide), "_foundation_s": wide_sliced}))
    deviation = lambda s: let(F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.size(s), lambda m: F.round(F.try_divide(F.sqrt(total(s, lambda x: (x - m) * (x - m)) / F.size(s)), m), 6))
    some = F.coalesce(F.size("_crown_s") > 0, F.lit(False))
    out = solid.fixed(put(out, {
        "crown_width_mm": F.when(some, percentile(F.col("_crown_s"), 0.1)).otherwise(F.col("_crown_w")), "crown_width_min_mm": F.when(some, F.array_min("_crown_s")), "crown_width_max_mm": F.when(some, F.array_max("_crown_s")),
        "crown_width_cv": F.when(some, deviation(F.col("_crown_s"))), "foundation_width_mm": F.when(F.size("_foundation_s") > 0, percentile(F.col("_foundation_s"), 0.1)).otherwise(F.col("_foundation_w")),
        "crown_slope_percent": mean(F.col("_crown"), lambda g: F.least(F.tan(F.acos(F.greatest(F.least(g["gz"], F.lit(1.0)), F.lit(-1.0)))) * 100, F.lit(1e6))),
        "_flow": solid.held(x=total(F.col("_crown"), lambda g: g["gx"] * g["area"]), y=total(F.col("_crown"), lambda g: g["gy"] * g["area"])),
        "_f": solid.held(**{c: mean(of("front"), lambda g, c=c: g[f"g{c}"]) for c in "xyz"}),
    }))
    out = solid.fixed(put(out, {"_flow_n": F.expr("sqrt(_flow.x * _flow.x + _flow.y * _flow.y)"), "_flat": F.expr("sqrt(_f.x * _f.x + _f.y * _f.y)"), "_len": F.expr("sqrt(_f.x * _f.x + _f.y * _f.y + _f.z * _f.z)")}))
    out = solid.fixed(put(out, {f"crown_flow_{c}": F.expr(f"IF(size(_crown) > 0, IF(_flow_n / greatest(crown_area, 1e-300) > 1e-10, _flow.{c} / _flow_n, 0D), NULL)") for c in "xy"}))
    both = (F.size("_front_p") > 0) & (F.size("_back_p") > 0)
    out = solid.fixed(put(out, {f"_{s}_s": F.sort_array(F.transform(f"_{s}_p", _across)) for s in ("front", "back")}))
    out = solid.fixed(put(out, {f"_{s}_{n}": percentile(F.col(f"_{s}_s"), q) for s in ("front", "back") for n, q in (("mid", 0.5), ("p10", 0.1), ("p90", 0.9))}))
    at = lambda side, f: F.transform(F.filter(f"_{side}_p", lambda p: F.abs((p["x"] - f["px"]) * f["tx"] + (p["y"] - f["py"]) * f["ty"]) < F.col("_tolerance")), lambda p: p["x"] * f["nx"] + p["y"] * f["ny"])
    thick = F.filter(F.transform("line", lambda f: let(structs(a=at("front", f), b=at("back", f)), lambda s: F.when((F.size(s["a"]) > 0) & (F.size(s["b"]) > 0), F.abs(median(s["a"]) - median(s["b"]))))), lambda w: F.coalesce(w > F.col("_eps"), F.lit(False)))
    heights = _slices(F.concat("_front_p", "_back_p"), lambda q, f: F.when(F.size(F.array_distinct(F.transform(q, lambda p: p["vid"]))) >= 2, _extent(q, lambda p: p["z"])))
    out = solid.fixed(put(out, {"_thick": F.when(F.col("local") & both, thick), "_heights": F.when(F.size("line") >= 3, heights)}))
    out = solid.fixed(put(out, {
        "_cos": F.expr("IF(_len > 1e-10 AND try_divide(_flat, _len) > 1e-10, try_divide(_flat, _len), 1D)"),
        "_avg": F.expr("abs(_front_mid - _back_mid)"),
        "_min": F.expr("IF(size(_front_p) >= 4 AND size(_back_p) >= 4, IF(_front_mid < _back_mid, abs(_back_p10 - _front_p90), abs(_back_p90 - _front_p10)), abs(_front_mid - _back_mid))"),
        "front_inclination_deg": F.expr("IF(_flat < 1e-10, 90D, degrees(atan2(abs(_f.z), _flat)))"),
        "_z": let(F.concat("_front_p", "_back_p"), lambda p: F.when(F.size(p) > 0, highest(p, lambda q: q["z"]) - lowest(p, lambda q: q["z"]))),
    }))
    by_slice = F.coalesce(F.size("_thick") > 0, F.lit(False))
    out = solid.fixed(put(out, {
        "min_wall_thickness_mm": F.when(by_slice, F.array_min("_thick") * 1000).otherwise(F.expr("IF(_min = 0, _avg, _min) * 1000 * _cos")),
        "avg_wall_thickness_mm": F.when(by_slice, total(F.col("_thick"), lambda x: x) / F.size("_thick") * 1000).otherwise(F.expr("_avg * 1000 * _cos")),
        "front_inclination_ratio": F.expr("CASE WHEN front_inclination_deg < 0.01 THEN double('Infinity') WHEN front_inclination_deg >= 90 THEN 0D ELSE 1 / tan(radians(front_inclination_deg)) END"),
        "wall_height_m": F.round("_z", 4), "wall_height_min_m": F.round(F.array_min("_heights"), 4), "wall_height_max_m": F.round(F.array_max("_heights"), 4), "wall_height_avg_m": F.when(F.size("_heights") > 0, F.round(total(F.col("_heights"), lambda x: x) / F.size("_heights"), 4)),
    }))
    xy = F.transform("line", lambda f: structs(x=f["px"], y=f["py"]))
    bend = let(F.filter(solid.segments(xy), lambda s: s["n"] > F.col("_eps")), lambda s: structs(l=median(F.transform(s, lambda q: q["n"])), k=median(F.transform(solid.turns(s), lambda a, i: a / F.greatest((F.get(s, i)["n"] + F.get(s, i + 1)["n"]) / 2, F.col("_eps"))))))
    sagitta = let(bend, lambda b: F.round(b["l"] * b["l"] * b["k"] / 8 * 1000, 1))
    out = solid.fixed(put(out, {
        "foundation_width_ratio": F.expr("round(try_divide(foundation_width_mm, wall_height_m * 1000), 6)"),
        "measurement_uncertainty_mm": F.when(F.col("is_curved") & (F.size("_crown") > 0), F.coalesce(sagitta, F.lit(0.0))).otherwise(0.0),
    }))
    names = [c for c in out.columns if c.startswith("_")]
    return with_curvature(out.drop(*names))


def curvature(line: Column) -> Column:
    """Turn over the mean of both segments at each inner point of a line; the ends as their neighbours."""
    xy = F.transform(line, lambda f: structs(x=f["px"], y=f["py"]))
    inner = let(solid.segments(xy), lambda s: F.transform(solid.turns(s), lambda a, i: F.try_divide(a, (F.get(s, i)["n"] + F.get(s, i + 1)["n"]) / 2)))
    return let(inner, lambda k: F.when(F.size(k) > 0, F.concat(F.array(k[0]), k, F.array(F.element_at(k, -1)))).otherwise(F.transform(xy, lambda p: F.lit(0.0))))


def with_curvature(solids: DataFrame) -> DataFrame:
    """Adds max_curvature, min_radius_m and mean_radius_m (by the segments' lengths) of curved lines."""
    out = solid.fixed(put(solids, {"_k": F.when(F.col("is_curved"), curvature(F.col("line")))}))
    xy = F.transform("line", lambda f: structs(x=f["px"], y=f["py"]))
    bent = let(solid.segments(xy), lambda s: let(F.filter(F.transform(s, lambda q, i: structs(n=q["n"], k=(F.get("_k", i) + F.get("_k", i + 1)) / 2)), lambda q: q["k"] > 1e-10), lambda r: F.try_divide(total(r, lambda q: q["n"] / q["k"]), total(r, lambda q: q["n"]))))
    return put(out, {"max_curvature": F.round(F.array_max("_k"), 6), "min_radius_m": F.when(F.array_max("_k") > 1e-10, F.round(1 / F.array_max("_k"), 2)), "mean_radius_m": F.when(F.col("_k").isNotNull(), F.round(bent, 2))}).drop("_k")


def with_plumbness(solids: DataFrame, category: str = "front") -> DataFrame:
    """Lean of the category's faces in degrees; plumb below half a degree."""
    lean = lambda g: F.degrees(F.asin(F.least(F.abs(g["gz"]), F.lit(1.0))))
    g = of(category)
    return put(solids, {f"{category}_plumbness_deg": F.round(F.try_divide(total(g, lambda x: lean(x) * x["area"]), total(g, lambda x: x["area"])), 3), "is_plumb": F.when(F.size(g) > 0, highest(g, lean) < 0.5)})


def with_slopes(solids: DataFrame) -> DataFrame:
    """Adds ``slopes``, one a triangle: total, cross and long slope in percent in its frame (9000 for upright faces)."""
    pct = lambda x, e: F.when(F.abs(x["uz"]) < 1e-10, 9000.0).otherwise(e / F.abs(x["uz"]) * 100)
    one = lambda x: let(solid.frame(x["mx"], x["my"], F.col("line"), F.col("local")), lambda f: structs(fid=x["fid"], area=x["area"], slope_pct=pct(x, F.sqrt(x["ux"] * x["ux"] + x["uy"] * x["uy"])), cross_pct=pct(x, F.abs(x["ux"] * f["nx"] + x["uy"] * f["ny"])), long_pct=pct(x, F.abs(x["ux"] * f["tx"] + x["uy"] * f["ty"]))))
    return solid.fixed(put(solids, {"slopes": F.transform("t", one)}))


def with_surface_slopes(solids: DataFrame, categories: tuple[str, ...] = ("crown",)) -> DataFrame:
    """Area-weighted means and extremes over the faces of some categories; null without such faces."""
    held = F.transform(members(F.filter("groups", lambda g: g["category"].isin(*categories))), lambda m: m["fid"])
    out = solid.fixed(put(put(solids, {"_f": F.sort_array(held)}), {"_s": F.sort_array(F.concat(F.transform("_f", lambda f: structs(fid=f, slope=F.lit(None).cast(solids.schema["slopes"].dataType.elementType.simpleString()))), F.transform("slopes", lambda s: structs(fid=s["fid"], slope=s))))}))
    out = solid.fixed(put(out, {"_s": F.transform(F.filter(solid.grouped(F.col("_s"), lambda s: s["fid"]), lambda r: F.size(r) == 2), lambda r: F.element_at(r, -1)["slope"])}))
    stats = {}
    for c in ("cross", "long"):
        stats |= {f"{c}_slope_avg_pct": F.try_divide(total(F.col("_s"), lambda s, c=c: s[f"{c}_pct"] * s["area"]), total(F.col("_s"), lambda s: s["area"])), f"{c}_slope_max_pct": highest(F.col("_s"), lambda s, c=c: s[f"{c}_pct"])}
    return solid.fixed(put(out, stats).drop("_f", "_s"))


def with_taper(solids: DataFrame, slices: int = 10) -> DataFrame:
    """Thickness at heights between 5 and 95 percent: distance of the sides' median across places in a band."""
    sides = F.flatten(F.transform(F.filter("groups", lambda g: g["category"].isin("front", "back")), lambda g: F.transform(corners(g["members"]), lambda p: structs(front=g["category"] == "front", vid=p["vid"], z=p["z"], s=_across(p)))))
    out = solid.fixed(put(solids, {"_p": F.transform(solid.grouped(F.sort_array(sides), lambda p: F.struct(p["front"], p["vid"])), lambda r: r[0])}))
    out = solid.fixed(put(out, {"_z": solid.held(lo=lowest(F.col("_p"), lambda p: p["z"]), h=highest(F.col("_p"), lambda p: p["z"]) - lowest(F.col("_p"), lambda p: p["z"]))}))

    def at(i: Column) -> Column:
        height = F.col("_z.lo") + F.col("_z.h") * (0.05 + 0.9 * i / (slices - 1))
        band = F.filter("_p", lambda p: F.abs(p["z"] - height) <= F.col("_z.h") / slices * 0.6)
        mid = lambda b, front: median(F.transform(F.filter(b, lambda p: p["front"] == front), lambda p: p["s"]))
        return let(band, lambda b: structs(height=height, mm=F.abs(mid(b, True) - mid(b, False)) * 1000))

    out = solid.fixed(put(out, {"taper": F.filter(F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), at), lambda s: s["mm"].isNotNull())}))
    n = F.size("taper")
    mean = structs(h=total(F.col("taper"), lambda s: s["height"]) / n, mm=total(F.col("taper"), lambda s: s["mm"]) / n)
    slope = let(mean, lambda m: structs(mean=m["mm"], k=F.try_divide(total(F.col("taper"), lambda s: (s["height"] - m["h"]) * (s["mm"] - m["mm"])), total(F.col("taper"), lambda s: (s["height"] - m["h"]) * (s["height"] - m["h"])))))
    out = solid.fixed(put(out, {"_m": F.when(n > 0, slope)}))
    least, most = lowest(F.col("taper"), lambda s: s["mm"]), highest(F.col("taper"), lambda s: s["mm"])
    return put(out, {
        "n_slices": n.cast("bigint"), "thickness_min_mm": least, "thickness_max_mm": most, "thickness_at_base_mm": F.get("taper", F.lit(0))["mm"], "thickness_at_crown_mm": F.get("taper", n - 1)["mm"],
        "taper_ratio": F.when((n > 1) & (F.abs(F.col("_m.k")) > 0.1), F.abs(1000 / F.col("_m.k"))), "is_tapered": F.try_divide(most - least, F.col("_m.mean")) > 0.05,
    }).drop("_p", "_z", "_m")


def planarity(solids: DataFrame, category: str = "front", key: str = KEY) -> DataFrame:
    """(key, rms_mm, max_mm, is_planar): distances of the category's vertices from their best plane; planar below a millimetre.

    The plane's normal is the eigenvector of the smallest eigenvalue of the 3 x 3 spread, in closed form.
    """
    p = put(solids, {"p": corners(members(of(category)))}).select(key, "p").where("size(p) > 0")
    mean = structs(**{c: total(F.col("p"), lambda q, c=c: q[c]) / F.size("p") for c in "xyz"})
    spread = lambda m: structs(x=m["x"], y=m["y"], z=m["z"], **{a + b: total(F.col("p"), lambda q, a=a, b=b: (q[a] - m[a]) * (q[b] - m[b])) / F.size("p") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")})
    p = put(p, {"s": let(mean, spread)})
    q = "(s.xx + s.yy + s.zz) / 3"
    off = "s.xy * s.xy + s.xz * s.xz + s.yz * s.yz"
    p = put(put(p, {"_q": F.expr(q)}), {"_p": F.expr(f"sqrt((pow(s.xx - _q, 2) + pow(s.yy - _q, 2) + pow(s.zz - _q, 2) + 2 * ({off})) / 6)")})
    b = {a: f"((s.{a} - {'_q' if a[0] == a[1] else '0'}) / IF(_p = 0, 1D, _p))" for a in ("xx", "xy", "xz", "yy", "yz", "zz")}
    det = f"({b['xx']} * ({b['yy']} * {b['zz']} - {b['yz']} * {b['yz']}) - {b['xy']} * ({b['xy']} * {b['zz']} - {b['yz']} * {b['xz']}) + {b['xz']} * ({b['xy']} * {b['yz']} - {b['yy']} * {b['xz']}))"
    p = put(p, {"_l": F.expr(f"_q + 2 * _p * cos(acos(greatest(-1D, least(1D, {det} / 2))) / 3 + 2 * pi() / 3)")})
    # a normal spans what two rows of (spread - smallest eigenvalue) leave: the longest of their three cross products
    r = [["s.xx - _l", "s.xy", "s.xz"], ["s.xy", "s.yy - _l", "s.yz"], ["s.xz", "s.yz", "s.zz - _l"]]
    cross = lambda u, v: [f"({u[1]}) * ({v[2]}) - ({u[2]}) * ({v[1]})", f"({u[2]}) * ({v[0]}) - ({u[0]}) * ({v[2]})", f"({u[0]}) * ({v[1]}) - ({u[1]}) * ({v[0]})"]
    forms = [cross(r[i], r[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    p = put(p, {"_c": F.expr("array_max(array(" + ", ".join(f"named_struct('n', pow({x}, 2) + pow({y}, 2) + pow({z}, 2), 'x', {x}, 'y', {y}, 'z', {z})" for x, y, z in forms) + "))")})
    dist = F.transform("p", lambda v: F.abs((v["x"] - F.col("s.x")) * F.col("_c.x") + (v["y"] - F.col("s.y")) * F.col("_c.y") + (v["z"] - F.col("s.z")) * F.col("_c.z")) / F.sqrt("_c.n") * 1000)
    # points on a line leave no cross product: any plane through it holds them
    d = put(p, {"_d": F.when((F.size("p") >= 3) & (F.col("_c.n") > 0), dist).otherwise(F.array(F.lit(0.0)))})
    rms = F.sqrt(total(F.col("_d"), lambda x: x * x) / F.size("_d"))
    return put(d, {"rms_mm": F.round(rms, 3), "max_mm": F.round(F.array_max("_d"), 3), "is_planar": rms < 1}).select(key, "rms_mm", "max_mm", "is_planar")


def hull(points: Column) -> Column:
    """Convex outline of points (x, y), counter-clockwise from the leftmost: the monotone chain, lower then upper side."""
    turn = lambda a, b, c: (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])
    # the last points that a new one turns away from go; of n points the chain keeps those before the first such place
    def chain(rows: Column) -> Column:
        def add(h: Column, p: Column) -> Column:
            keep = F.aggregate(F.sequence(F.lit(1), F.size(h) + 1), F.size(h), lambda k, _: F.when((k >= 2) & (turn(F.get(h, k - 2), F.get(h, k - 1), p) <= 0), k - 1).otherwise(k))
            return F.concat(F.slice(h, F.lit(1), keep), F.array(p))

        return F.aggregate(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), F.slice(rows, F.lit(1), F.lit(1)), add)

    def both(s: Column) -> Column:
        low, up = chain(s), chain(F.reverse(s))
        return F.when(F.size(s) < 3, s).otherwise(let(structs(a=low, b=up), lambda h: F.concat(F.slice(h["a"], F.lit(1), F.size(h["a"]) - 1), F.slice(h["b"], F.lit(1), F.size(h["b"]) - 1))))

    return let(F.sort_array(F.array_distinct(points)), both)


def sections(solids: DataFrame, fractions: tuple[float, ...] = (0.5,), tolerance: float | None = None, key: str = KEY) -> DataFrame:
    """(key, fraction, position_m, n, width, height, outline): cross-sections at fractions of the line's length.

    A section takes the vertices near the line's point nearest to that length (of a line of two points, a point between them);
    with fewer than three there is none. The outline is the convex hull in (across, z).
    """
    dense = lambda f: structs(px=F.col("line")[0]["px"] + f * (F.col("line")[1]["px"] - F.col("line")[0]["px"]), py=F.col("line")[0]["py"] + f * (F.col("line")[1]["py"] - F.col("line")[0]["py"]), tx=F.col("line")[0]["tx"], ty=F.col("line")[0]["ty"], nx=F.col("line")[0]["nx"], ny=F.col("line")[0]["ny"], w=F.col("line")[0]["w"])
    place = lambda f: F.when(F.size("line") == 2, dense(f)).otherwise(F.get("line", F.round(f * (F.size("line") - 1)).cast("int")))
    reach = F.lit(tolerance) if tolerance else F.when(F.size("line") == 2, F.col("wall_length_m") / 2 * 1.0002).otherwise(slice_tolerance(F.col("line")))
    out = put(put(solids, {"_reach": reach}).select(key, "v", "line", "wall_length_m", "_reach"), {"fraction": F.explode(F.array(*map(F.lit, fractions)))})
    out = solid.fixed(put(out, {"_f": place(F.col("fraction"))}))
    near = F.filter("v", lambda p: F.abs((p["x"] - F.col("_f.px")) * F.col("_f.tx") + (p["y"] - F.col("_f.py")) * F.col("_f.ty")) < F.col("_reach"))
    out = solid.fixed(put(out, {"_p": F.transform(near, lambda p: structs(x=(p["x"] - F.col("_f.px")) * F.col("_f.nx") + (p["y"] - F.col("_f.py")) * F.col("_f.ny"), y=p["z"]))}).where("size(_p) >= 3"))
    return put(out, {"position_m": F.col("fraction") * F.col("wall_length_m"), "n": F.size("_p").cast("bigint"), "width": _extent(F.col("_p"), lambda p: p["x"]), "height": _extent(F.col("_p"), lambda p: p["y"]), "outline": hull(F.col("_p"))}).select(key, "fraction", "position_m", "n", "width", "height", "outline")


def profile_variation(solids: DataFrame, slices: int = 15, key: str = KEY) -> DataFrame:
    """(key, n_slices, width_cv, height_cv, is_variable) of cross-sections along the line; variable above 0.05."""
    s = sections(solids, tuple((i + 0.5) / slices for i in range(slices)), None, key)
    cv = lambda c: functions.expr(f"round(coalesce(try_divide(stddev_pop({c}), avg({c})), 0D), 6)").alias(f"{c}_cv")
    out = s.groupBy(key).agg(functions.count("*").alias("n_slices"), cv("width"), cv("height"))
    return put(out, {"is_variable": (F.col("width_cv") > 0.05) | (F.col("height_cv") > 0.05)})


def enriched(solids: DataFrame) -> DataFrame:
    """Level 2 rows with role, level 3 and all enrichments."""
    return with_surface_slopes(with_slopes(with_taper(with_plumbness(with_level3(classify.describe(solids))))))


#: Variables of the rules' context by level (fixed values).
VARIABLES = (
    "volume", "total_area", "mesh_is_watertight", "num_triangles", "bbox_dim_max_m", "bbox_dim_mid_m", "bbox_dim_min_m", "bbox_height_m", "slenderness_ratio", "length_height_ratio", "volume_fill_ratio",
    "crown_area_m2", "foundation_area_m2", "front_area_m2", "back_area_m2", "front_back_area_ratio",
    "crown_width_mm", "crown_slope_percent", "min_wall_thickness_mm", "avg_wall_thickness_mm", "front_inclination_deg", "front_inclination_ratio", "is_curved", "wall_length_m", "wall_height_m", "wall_height_min_m", "wall_height_max_m", "wall_height_avg_m", "crown_width_cv", "foundation_width_mm", "foundation_width_ratio",
    "cross_slope_avg_pct", "cross_slope_max_pct", "long_slope_avg_pct", "long_slope_max_pct", "measurement_uncertainty_mm", "min_radius_m", "max_curvature", "thickness_at_crown_mm", "thickness_at_base_mm", "taper_ratio", "thickness_min_mm", "thickness_max_mm", "front_plumbness_deg", "is_plumb",
)


def context(solids: DataFrame, key: str = KEY) -> DataFrame:
    """The flat context of the rules from level 2 rows."""
    return flat(enriched(solids), key)


def flat(rich: DataFrame, key: str = KEY) -> DataFrame:
    """(key, is_wall_like, element_role, confidence, VARIABLES): the flat context of the rules, a row an element, of ``enriched``."""
    out = put(rich, {"_s": F.array_sort(F.array("size_x", "size_y", "size_z"))})
    out = put(out, {
        "total_area": total(F.col("t"), lambda x: x["area"]), "mesh_is_watertight": F.col("is_watertight"), "num_triangles": F.size("t"), "bbox_dim_max_m": F.expr("_s[2]"), "bbox_dim_mid_m": F.expr("_s[1]"), "bbox_dim_min_m": F.expr("_s[0]"), "bbox_height_m": F.col("size_z"),
        "slenderness_ratio": F.expr("round(size_z / greatest(_s[0], 1e-6), 2)"), "length_height_ratio": F.expr("round(_s[2] / greatest(size_z, 1e-6), 2)"), "volume_fill_ratio": F.expr("round(volume / IF(_s[0] > 0, _s[0] * _s[1] * _s[2], 1D), 4)"),
        "front_back_area_ratio": F.expr("IF(front_area + back_area > 0, round(greatest(front_area, back_area) / greatest(least(front_area, back_area), 1e-6), 3), 1D)"),
    } | {f"{c}_area_m2": F.col(f"{c}_area") for c in ("crown", "foundation", "front", "back")})
    return out.select(key, "is_wall_like", "element_role", "confidence", *VARIABLES)


def clearance(solids: DataFrame, polygon: list[tuple[float, float]], slices: int = 20, reference_z: float = 0.0, trim: float = 0.05, paired: int = 50, key: str = KEY) -> DataFrame:
    """(key, n_violations, n_slices_checked, max_penetration_mm, clear, violations): what of a mesh is inside a clear profile drawn along its line.

    Slices stand at even fractions of the line, its ends trimmed; each takes the line's point below its place, so points may come
    again and count again. A slice holds the vertices near its point and the midpoints of all pairs of the first ``paired`` of them. The
    profile is in (across, z over ``reference_z``). ``violations``: position_m, n_vertices and max_penetration_mm of each slice with
    points inside, in the line's order. Elements without a line are clear, with no slices checked. A row an element, no shuffle.
    """
    fractions = [trim + (1 - 2 * trim) * k / max(1, slices - 1) for k in range(slices)]
    xy = F.transform("line", lambda f: structs(x=f["px"], y=f["py"]))
    at = F.array(*(F.floor(F.lit(f) * (F.size("line") - 1)).cast("int") for f in fractions))
    out = put(solids, {"_reach": slice_tolerance(F.col("line")), "_at": F.when(F.size("line") > 0, at).otherwise(F.array().cast("array<int>")), "_gone": F.transform(solid.segments(xy), lambda s: s["n"])})
    out = solid.fixed(out.select(key, "v", "line", "_reach", "_at", "_gone"))

    def points(f: Column) -> Column:
        near = F.filter("v", lambda p: ((f["tx"] != 0) | (f["ty"] != 0)) & (F.abs((p["x"] - f["px"]) * f["tx"] + (p["y"] - f["py"]) * f["ty"]) < F.col("_reach")))
        flat = F.transform(near, lambda p: structs(x=(p["x"] - f["px"]) * f["nx"] + (p["y"] - f["py"]) * f["ny"], y=p["z"] - F.lit(reference_z)))
        middle = lambda p, q: structs(x=(p["x"] + q["x"]) / 2, y=(p["y"] + q["y"]) / 2)
        pairs = lambda a: F.flatten(F.transform(F.slice(a, F.lit(1), F.lit(paired)), lambda p, k: F.transform(F.slice(F.slice(a, F.lit(1), F.lit(paired)), k + 2, F.lit(paired)), lambda q: middle(p, q))))
        return let(flat, lambda a: F.concat(a, pairs(a)))

    out = solid.fixed(put(out, {"_points": F.transform(F.array_distinct("_at"), lambda i: structs(i=i, p=let(F.get("line", i), points)))}))
    inside, near = terrain.polygon_text(polygon, "p.x", "p.y")
    out = solid.fixed(put(out, {"_in": F.expr(f"filter(transform(_points, s -> named_struct('i', s.i, 'depth', transform(filter(s.p, p -> {inside}), p -> {near}))), s -> size(s.depth) > 0)")}))
    found = F.expr(
        "flatten(transform(_in, s -> array_repeat(named_struct('position_m', round(aggregate(slice(_gone, 1, s.i), 0D, (x, y) -> x + y), 2), 'n_vertices', CAST(size(s.depth) AS BIGINT), "
        "'max_penetration_mm', round(array_max(s.depth) * 1000, 1)), size(filter(_at, x -> x = s.i)))))"
    )
    out = solid.fixed(put(out, {"violations": found}))
    return out.selectExpr(
        key, "aggregate(violations, 0L, (x, s) -> x + s.n_vertices) AS n_violations", "CAST(size(_at) AS BIGINT) AS n_slices_checked",
        "coalesce(array_max(transform(violations, s -> s.max_penetration_mm)), 0D) AS max_penetration_mm", "size(violations) = 0 AS clear", "violations",
    )
