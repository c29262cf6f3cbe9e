"""Faces with corners that point in and with holes: areas by the shoelace formula, volumes of bodies made of them."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwright.sources import spf
from meshwright.sources.faces import clipped, with_triangles

L = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 3), (0, 3)]
C = [(0, 0), (5, 0), (5, 1), (1, 1), (1, 4), (5, 4), (5, 5), (0, 5)]
SQUARE, HOLES = [(0, 0), (10, 0), (10, 8), (0, 8)], [[(1, 1), (3, 1), (3, 3), (1, 3)], [(5, 2), (8, 4), (6, 6)], [(1, 5), (2, 7), (4, 5)]]


def shoelace(p):
    return sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(p, p[1:] + p[:1], strict=True)) / 2


def signed(points, tris):
    return [shoelace([tuple(points[i]) for i in t]) for t in tris]


def flat(loops, lift=lambda x, y: (x, y, 0.0)):
    return [np.array([lift(*map(float, q)) for q in p]) for p in loops]


@pytest.mark.parametrize("loops", [[L], [C], [L[::-1]], [SQUARE, *HOLES], [HOLES[0], SQUARE, HOLES[1][::-1]], [SQUARE[::-1], *HOLES]])
def test_areas(loops):
    outer = max(loops, key=lambda p: abs(shoelace(p)))
    want = abs(shoelace(outer)) - sum(abs(shoelace(p)) for p in loops if p is not outer)
    points = [q for p in loops for q in p]
    tris = clipped(flat(loops))
    areas = signed(points, tris)
    assert len(tris) == len(points) + 2 * (len(loops) - 1) - 2
    assert all(a * shoelace(outer) >= 0 for a in areas) and abs(sum(areas)) == pytest.approx(want)
    tilted = clipped(flat(loops, lambda x, y: (x, 0.3 * x + 0.5 * y, 2 * y - x)))
    assert abs(sum(signed(points, tilted))) == pytest.approx(want) and all(a * shoelace(outer) >= 0 for a in signed(points, tilted))


def test_random_outlines_with_holes():
    r = random.Random(3)
    for n in (5, 12, 40, 90):
        for holes in (0, 1, 4):
            ray = [(math.tau * i / n, r.uniform(4, 9)) for i in range(n)]
            outer = [(d * math.cos(a), d * math.sin(a)) for a, d in ray]
            # holes well within the smallest radius of a fine enough outline
            inner = [[(c + s * math.cos(t), e + s * math.sin(t)) for t in (0.1, 1.9, 2.2, 4.4)] for c, e, s in ((1, 0, 0.3), (-1, 0.4, 0.4), (0, 1, 0.2), (0.1, -1, 0.5))[:holes]]
            loops = [outer, *(p if r.random() < 0.5 else p[::-1] for p in inner)]
            tris = clipped(flat(loops))
            areas = signed([q for p in loops for q in p], tris)
            assert len(tris) == n + 4 * holes + 2 * holes - 2
            assert sum(map(abs, areas)) == pytest.approx(abs(shoelace(outer)) - sum(abs(shoelace(p)) for p in inner)) and min(areas) >= -1e-9


def test_convex_faces_stay_fans_and_odd_rows(spark):
    at = lambda p: [(float(x), float(y), 0.0) for x, y in p]
    rows = [("square", [at(SQUARE)]), ("l", [at(L)]), ("hole", [at(SQUARE), at(HOLES[0])]), ("none", None), ("empty", []), ("line", [at(L[:2])]), ("point", [at([(1, 1)] * 4)])]
    df = spark.createDataFrame(rows, "name string, loops array<array<struct<x:double,y:double,z:double>>>")
    got = {r["name"]: r["cut"] for r in with_triangles(df).collect()}
    assert {k: len(v) for k, v in got.items()} == {"square": 2, "l": 4, "hole": 8, "none": 0, "empty": 0, "line": 0, "point": 2}
    assert [[(q["x"], q["y"]) for q in t] for t in got["square"]] == [[(0, 0), (10, 0), (10, 8)], [(0, 0), (10, 8), (0, 8)]]
    areas = {k: sum(shoelace([(q["x"], q["y"]) for q in t]) for t in got[k]) for k in ("l", "hole")}
    assert areas == {"l": pytest.approx(6.0), "hole": pytest.approx(76.0)}


def _file(lines):
    return "ISO-10303-21;\nDATA;\n" + "\n".join(lines) + "\nENDSEC;\n"


def _lines(loops, start=100):
    """Points and closed polylines of plane loops; gives the lines and the polylines' numbers."""
    out, ids, k = [], [], start
    for p in loops:
        own = []
        for x, y in p:
            out.append(f"#{k}=IFCCARTESIANPOINT(({float(x)},{float(y)}));")
            own.append(k)
            k += 1
        out.append(f"#{k}=IFCPOLYLINE(({','.join(f'#{i}' for i in [*own, own[0]])}));")
        ids.append(k)
        k += 1
    return out, ids


def _wall(profile):
    return [*profile, "#19=IFCDIRECTION((0.,0.,1.));", "#20=IFCEXTRUDEDAREASOLID(#18,$,#19,3.);", "#21=IFCSHAPEREPRESENTATION(#11,'Body','SweptSolid',(#20));", "#22=IFCPRODUCTDEFINITIONSHAPE($,$,(#21));", "#16=IFCWALL('w',$,'w',$,$,$,#22,$,$);"]


def test_bodies_of_files(spark, tmp_path):
    for name, loops in (("l", [L]), ("c", [C[::-1]]), ("holes", [SQUARE, *HOLES])):
        lines, ids = _lines(loops)
        voids = f",({','.join(f'#{i}' for i in ids[1:])})" if len(ids) > 1 else ""
        kind = "IFCARBITRARYPROFILEDEFWITHVOIDS" if voids else "IFCARBITRARYCLOSEDPROFILEDEF"
        (tmp_path / f"{name}.ifc").write_text(_file(_wall([*lines, f"#18={kind}(.AREA.,$,#{ids[0]}{voids});"])))
    # a slab with a hole through it, as faces: the two flat ones have a bound within the other
    outer, inner = [(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (1, 2), (2, 2), (2, 1)]
    lines, faces, k = [], [], 100
    loops_of = [[[(x, y, 0) for x, y in p[::-1]] for p in (outer, inner)], [[(x, y, 2) for x, y in p] for p in (outer, inner)]]
    loops_of += [[[(*a, 0), (*b, 0), (*b, 2), (*a, 2)]] for p in (outer, inner) for a, b in zip(p, p[1:] + p[:1], strict=True)]
    for loops in loops_of:
        bounds = []
        for j, p in enumerate(loops):
            own = []
            for q in p:
                lines.append(f"#{k}=IFCCARTESIANPOINT(({','.join(map(str, map(float, q)))}));")
                own.append(k)
                k += 1
            lines += [f"#{k}=IFCPOLYLOOP(({','.join(f'#{i}' for i in own)}));", f"#{k + 1}=IFCFACE{'' if j else 'OUTER'}BOUND(#{k},.T.);"]
            bounds.append(k + 1)
            k += 2
        lines.append(f"#{k}=IFCFACE(({','.join(f'#{b}' for b in bounds)}));")
        faces.append(k)
        k += 1
    lines += [f"#17=IFCCLOSEDSHELL(({','.join(f'#{f}' for f in faces)}));", "#20=IFCFACETEDBREP(#17);", "#21=IFCSHAPEREPRESENTATION(#11,'Body','Brep',(#20));", "#22=IFCPRODUCTDEFINITIONSHAPE($,$,(#21));", "#16=IFCWALL('w',$,'w',$,$,$,#22,$,$);"]
    (tmp_path / "slab.ifc").write_text(_file(lines))
    tris = spf.triangles(spf.entities(spf.texts(spark, str(tmp_path))))
    area = "sqrt(pow((y1-y0)*(z2-z0)-(z1-z0)*(y2-y0),2)+pow((z1-z0)*(x2-x0)-(x1-x0)*(z2-z0),2)+pow((x1-x0)*(y2-y0)-(y1-y0)*(x2-x0),2))/2"
    volume = "(x0*(y1*z2-z1*y2)+y0*(z1*x2-x1*z2)+z0*(x1*y2-y1*x2))/6"
    got = {r["model_id"]: r for r in tris.groupBy("model_id").agg(F.sum(F.expr(area)).alias("area"), F.sum(F.expr(volume)).alias("volume"), F.count("*").alias("n")).collect()}
    around = lambda p: sum(math.dist(a, b) for a, b in zip(p, p[1:] + p[:1], strict=True))
    for name, loops in (("l", [L]), ("c", [C]), ("holes", [SQUARE, *HOLES])):
        flat_area = abs(shoelace(loops[0])) - sum(abs(shoelace(p)) for p in loops[1:])
        assert abs(got[name]["volume"]) == pytest.approx(3 * flat_area), name
        assert got[name]["area"] == pytest.approx(2 * flat_area + 3 * sum(map(around, loops))), name
    assert got["slab"]["volume"] == pytest.approx(30) and got["slab"]["area"] == pytest.approx(2 * 15 + 2 * 20) and got["slab"]["n"] == 2 * 8 + 16
