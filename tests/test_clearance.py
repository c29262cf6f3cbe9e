"""Clearance along centrelines against a plain second reading of the rules."""

import numpy as np
import pytest
from meshwright.operators import classify, measure, solid
from meshwright.sources import tables

PROFILE = [(-0.2131, 0.0), (0.2131, 0.0), (0.2131, 2.207), (0.05, 1.1), (-0.2131, 2.207)]


def inside(x, y):
    hit = False
    for (p, q), (r, s) in zip(PROFILE, PROFILE[1:] + PROFILE[:1], strict=True):
        if (y < q) != (y < s) and x < (r - p) * (y - q) / (s - q) + p:
            hit = not hit
    return hit


def depth(x, y):
    out = []
    for a, b in zip(np.array(PROFILE), np.array(PROFILE[1:] + PROFILE[:1]), strict=True):
        t = np.clip(np.dot([x, y] - a, b - a) / np.dot(b - a, b - a), 0, 1)
        out.append(np.hypot(*([x, y] - a - t * (b - a))))
    return min(out)


def plain(line, v, z, slices=20):
    at = np.array([[f["px"], f["py"]] for f in line])
    gaps = np.hypot(*np.diff(at, axis=0).T) if len(at) > 1 else np.zeros(0)
    reach = np.median(gaps) * 0.6 if len(gaps) else 0.5
    found = []
    for k in (np.linspace(0.05, 0.95, slices) * (len(line) - 1)).astype(int):
        f = line[k]
        near = [p for p in v if abs((p["x"] - f["px"]) * f["tx"] + (p["y"] - f["py"]) * f["ty"]) < reach]
        points = [np.array([p["x"], p["y"], p["z"]]) for p in near]
        points += [(a + b) / 2 for i, a in enumerate(points[:50]) for b in points[i + 1 : 50]]
        flat = [((p[0] - f["px"]) * f["nx"] + (p[1] - f["py"]) * f["ny"], p[2] - z) for p in points]
        deep = [depth(*p) for p in flat if inside(*p)]
        if deep:
            found.append((gaps[:k].sum(), len(deep), max(deep) * 1000))
    return found


@pytest.mark.parametrize("shape", ["box", "bent", "stepped"])
def test_clearance_against_a_plain_reading(spark, shape):
    make = {"box": tables.meshes, "bent": tables.bent, "stepped": tables.stepped}[shape]
    walls = tables.walls(spark, "/root/testdata/sf0.001").where("element_id < 25")
    solids = solid.with_centreline(classify.classified(make(walls))).select("element_id", "v", "line").cache()
    got = {r["element_id"]: r for r in measure.clearance(solids, PROFILE, reference_z=1.003).collect()}
    some = 0
    for r in solids.collect():
        g, want = got[r["element_id"]], plain(r["line"], r["v"], 1.003)
        assert g["n_violations"] == sum(n for _, n, _ in want) and g["n_slices_checked"] == 20 and g["clear"] == (not want)
        assert [s["n_vertices"] for s in g["violations"]] == [n for _, n, _ in want]
        for s, (place, _, deep) in zip(g["violations"], want, strict=True):
            assert abs(s["position_m"] - place) < 0.0051 and abs(s["max_penetration_mm"] - deep) < 0.051
        some += bool(want)
    assert some > 5


def test_clearance_without_a_line(spark):
    v = "array<struct<vid:int,x:double,y:double,z:double>>"
    line = "array<struct<px:double,py:double,tx:double,ty:double,nx:double,ny:double,w:double>>"
    one = [(0, 0.0, 0.0, 1.0)]
    rows = [(1, one, None), (2, [], [(0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0)]), (3, one, []), (4, one, [(0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)])]
    got = {r["element_id"]: r for r in measure.clearance(spark.createDataFrame(rows, f"element_id int, v {v}, line {line}"), PROFILE).collect()}
    assert [(got[k]["n_violations"], got[k]["n_slices_checked"], got[k]["clear"]) for k in (1, 2, 3, 4)] == [(0, 0, True), (0, 20, True), (0, 0, True), (0, 20, True)]
