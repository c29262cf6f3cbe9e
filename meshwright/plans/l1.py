"""L1 and mesh graph queries over the derived walls, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, large, mesh, solid
from ..operators.spread import dealt, evenly
from ..sources import faces, tables
from .sql_base import NORMALS, TRIS, VERTS, WALLS, with_


def _mesh(spark, d):
    w = tables.walls(spark, d)
    return tables.vertices(w), tables.triangles(w)


def _r(*names, digits=6):
    return [F.round(n, digits).alias(n) for n in names]


def _solids(spark, d):
    return solid.faced(tables.meshes(tables.walls(spark, d)))


def l1_volume(spark, d):
    return _solids(spark, d).select("element_id", *_r("volume"))


def l1_surface_area(spark, d):
    return _solids(spark, d).selectExpr("element_id", f"round({solid.total('t', lambda x: x['area'])}, 6) AS total_area")


def l1_bbox(spark, d):
    return _solids(spark, d).select("element_id", *(f"{n}_{c}" for c in "xyz" for n in ("min", "max", "size")))


def l1_centroid(spark, d):
    return solid.with_centroid(_solids(spark, d)).select("element_id", *_r("cx", "cy", "cz"))


def l1_watertight(spark, d):
    return _solids(spark, d).select("element_id", "is_watertight", "num_edges", "non_manifold_edges")


def l1_mesh_quality(spark, d):
    q = mesh.quality(_mesh(spark, d)[1])
    return q.select("element_id", *_r("min_area", "max_area", "median_area", "min_edge", "max_edge", "median_edge"), "degenerate", "num_triangles", "non_manifold_edges")


def l1_degenerate_filter(spark, d):
    """One wall in seven gets a triangle collapsed to a line, which must go."""
    t = _mesh(spark, d)[1]
    flat = t.where("element_id % 7 = 0 AND fid = 0").withColumns({"fid": F.lit(99), "c": F.col("a")} | {f"{c}2": F.col(f"{c}0") for c in "xyz"})
    out = mesh.drop_degenerate(t.union(flat.select(t.columns)))
    return out.groupBy("element_id").agg(F.count("*").alias("kept"), F.max("n_degenerate").alias("dropped"), F.max("fid").alias("last_fid"))


def l1_winding_repair(spark, d):
    return _solids(spark, d).select("element_id", "normals_flipped", F.round(F.when(F.col("normals_flipped"), -F.col("signed_volume")).otherwise(F.col("signed_volume")), 6).alias("signed_volume"))


def soup_join(spark, d):
    """Triangles rebuilt from a vertex table and an index table must equal the derived ones."""
    v, t = _mesh(spark, d)
    return mesh.signed_volume(tables.soup(v, t.select("element_id", "fid", "a", "b", "c"))).select("element_id", "signed_volume")


def weld_vertices(spark, d):
    """Every vertex twice, the copies as vid + 8: they weld onto the first."""
    v = _mesh(spark, d)[0]
    return graph.weld(v.union(v.withColumn("vid", F.col("vid") + 8)))


def face_adjacency(spark, d):
    return graph.adjacency(_mesh(spark, d)[1])


def _two_bodies(spark, d):
    """Walls of every fourth part have a second body, a unit higher and without its bottom's first triangle."""
    t = _mesh(spark, d)[1]
    other = t.where("element_id % 4 = 0 AND fid > 0").withColumns({"fid": F.col("fid") + 12} | {k: F.col(k) + 8 for k in "abc"} | {f"z{i}": F.col(f"z{i}") + 10 for i in range(3)})
    return t.union(other.select(t.columns))


def face_components(spark, d):
    """Bodies of walls of which some have two, from a row a triangle."""
    s = solid.faced(solid.rows(_two_bodies(spark, d)))
    s = solid.fixed(s.withColumn("_body", solid.components("near", "size(t)")))
    rows = F.transform("t", lambda x, i: F.struct(x["fid"].alias("fid"), F.get("t", F.get(F.col("_body"), i))["fid"].alias("component")))
    return s.select("element_id", F.inline(rows))


def largest_body(spark, d):
    s = solid.largest_body(solid.faced(solid.rows(_two_bodies(spark, d))))
    return s.select("element_id", F.col("t")[0]["fid"].alias("component"), F.expr(f"round({solid.total('t', lambda x: x['area'])}, 6)").alias("area"), F.col("num_bodies").cast("bigint").alias("num_bodies"))


def coplanar_groups(spark, d):
    s = solid.labelled(_solids(spark, d))
    return s.select("element_id", F.inline(F.transform("t", lambda x, i: F.struct(x["fid"].alias("fid"), F.get("t", F.get("label", i))["fid"].alias("component")))))


def group_properties(spark, d):
    g = solid.with_groups(solid.labelled(_solids(spark, d)))
    g = g.select("element_id", F.inline(F.transform("groups", lambda x: F.struct(*(x[c].alias(c) for c in ("group_id", "num_triangles", "area", "px", "py", "pz", "gx", "gy", "gz"))))))
    return g.select("element_id", "group_id", "num_triangles", *_r("area", "px", "py", "pz"), *(F.expr(f"round(g{c}, 6) + 0D").alias(f"g{c}") for c in "xyz"))


#: So small that some of the site meshes are large at every scale but the least.
SITE_LIMIT = 960


def _site_meshes(spark, d):
    """All walls of a brand as one mesh of many bodies; it grows with the table."""
    w = tables.walls(spark, d)
    t = evenly(tables.triangles(w), w.select("element_id", "model_id"), "element_id")
    return t.withColumns({"fid": F.col("element_id") * 12 + F.col("fid")} | {v: F.col("element_id") * 8 + F.col(v) for v in "abc"}).withColumn("element_id", F.col("model_id")).drop("model_id")


def site_mesh_level1(spark, d):
    """Level 1 of meshes that needn't fit a row."""
    s = large.level1(_site_meshes(spark, d), SITE_LIMIT)
    return s.select("element_id", "num_triangles", "num_edges", "non_manifold_edges", "is_watertight", *_r("signed_volume", "total_area", "cx", "cy", "cz"), *(f"{n}_{c}" for c in "xyz" for n in ("min", "max")))


def site_mesh_bodies(spark, d):
    """The largest body of each."""
    return large.largest_body(_site_meshes(spark, d)).select("element_id", "component", *_r("area"), "num_bodies")


def site_mesh_groups(spark, d):
    """Coplanar groups of meshes that needn't fit a row."""
    g = large.groups(_site_meshes(spark, d), SITE_LIMIT)
    return g.select("element_id", "group_id", "num_triangles", *_r("area", "px", "py", "pz"), *(F.expr(f"round(g{c}, 6) + 0D").alias(f"g{c}") for c in "xyz"))


def profile_faces(spark, d):
    """Faces with corners that point in and with a hole, of the walls' sizes: triangles and their area."""
    at = lambda x, z: f"named_struct('x', {x}, 'y', 0D, 'z', {z})"
    loop = lambda *p: f"array({', '.join(at(x, z) for x, z in p)})"
    ell = loop(("0D", "0D"), ("l", "0D"), ("l", "t"), ("t", "t"), ("t", "h"), ("0D", "h"))
    clasp = loop(("0D", "0D"), ("l", "0D"), ("l", "t"), ("t", "t"), ("t", "h - t"), ("l", "h - t"), ("l", "h"), ("0D", "h"))
    outline, hole = loop(("0D", "0D"), ("l", "0D"), ("l", "h"), ("0D", "h")), loop(("t", "t"), ("l - t", "t"), ("l - t", "h - t"), ("t", "h - t"))
    rows = dealt(tables.walls(spark, d), "element_id", 4 + 6 + 8).selectExpr("element_id", f"stack(3, 'ell', array({ell}), 'clasp', array({clasp}), 'frame', array({outline}, {hole})) AS (kind, loops)")
    area = "aggregate(cut, 0D, (s, p) -> s + abs((p[1].x - p[0].x) * (p[2].z - p[0].z) - (p[1].z - p[0].z) * (p[2].x - p[0].x)) / 2)"
    return faces.with_triangles(rows).selectExpr("element_id", "kind", "CAST(size(cut) AS BIGINT) AS num_triangles", f"round({area}, 6) AS area")



_T = with_(WALLS, VERTS, TRIS)
_N = with_(WALLS, VERTS, TRIS, NORMALS)
_EDGES = "edges AS (SELECT element_id, fid, least(a, b) AS lo, greatest(a, b) AS hi FROM tris UNION ALL SELECT element_id, fid, least(b, c), greatest(b, c) FROM tris UNION ALL SELECT element_id, fid, least(c, a), greatest(c, a) FROM tris)"
_VOLUME = "sum(x0 * (y1 * z2 - z1 * y2) + y0 * (z1 * x2 - x1 * z2) + z0 * (x1 * y2 - y1 * x2)) / 6"
_CENTRED = ", ".join(f"avg({c}) AS m{c}" for c in "xyz")
_ABOUT = "sum((x0 - mx) * ((y1 - my) * (z2 - mz) - (z1 - mz) * (y2 - my)) + (y0 - my) * ((z1 - mz) * (x2 - mx) - (x1 - mx) * (z2 - mz)) + (z0 - mz) * ((x1 - mx) * (y2 - my) - (y1 - my) * (x2 - mx))) / 6"
_SIGNED = f"sv AS (SELECT element_id, {_ABOUT} AS signed_volume FROM tris JOIN (SELECT element_id, {_CENTRED} FROM verts GROUP BY 1) USING (element_id) GROUP BY 1)"
_TIGHT = "tight AS (SELECT element_id, min(CASE WHEN n = 2 THEN 1 ELSE 0 END) = 1 AS is_watertight, count(*) AS num_edges, count(*) FILTER (WHERE n <> 2) AS non_manifold_edges FROM (SELECT element_id, lo, hi, count(*) AS n FROM edges GROUP BY ALL) GROUP BY 1)"
_ADJ = "adj AS (SELECT DISTINCT e.element_id, m.f, e.fid AS g FROM edges e JOIN (SELECT element_id, lo, hi, min(fid) AS f FROM edges GROUP BY ALL) m USING (element_id, lo, hi) WHERE e.fid <> m.f)"
_CLOSE = """reach(element_id, f, g) AS (SELECT element_id, fid, fid FROM tris UNION SELECT r.element_id, r.f, CASE WHEN p.f = r.g THEN p.g ELSE p.f END FROM reach r JOIN {pairs} p ON p.element_id = r.element_id AND (p.f = r.g OR p.g = r.g)),
comp AS (SELECT element_id, f AS fid, min(g) AS component FROM reach GROUP BY ALL)"""
_TWO = TRIS.replace("\ntris AS", "\ntris1 AS") + """, tris AS (SELECT * FROM tris1 UNION ALL SELECT element_id, fid + 12, a + 8, b + 8, c + 8, x0, y0, z0 + 10, x1, y1, z1 + 10, x2, y2, z2 + 10 FROM tris1 WHERE element_id % 4 = 0 AND fid > 0)"""
_FIXED = TRIS.replace("\ntris AS", "\ntris0 AS") + f""", edges0 AS ({_EDGES[10:-1].replace("FROM tris", "FROM tris0")}), {_TIGHT.replace("tight AS", "tight0 AS").replace("FROM edges", "FROM edges0")},
flip AS (SELECT element_id, is_watertight AND v < 0 AS f FROM tight0 JOIN (SELECT element_id, {_VOLUME} AS v FROM tris0 GROUP BY 1) USING (element_id)),
tris AS (SELECT element_id, fid, a, CASE WHEN f THEN c ELSE b END AS b, CASE WHEN f THEN b ELSE c END AS c, x0, y0, z0, {", ".join(f"CASE WHEN f THEN {c}{3 - i} ELSE {c}{i} END AS {c}{i}" for i in (1, 2) for c in "xyz")}, f FROM tris0 JOIN flip USING (element_id))"""
_COPLANAR = "copl AS (SELECT j.* FROM adj j JOIN norms p ON p.element_id = j.element_id AND p.fid = j.f JOIN norms q ON q.element_id = j.element_id AND q.fid = j.g WHERE acos(greatest(least(p.ux * q.ux + p.uy * q.uy + p.uz * q.uz, 1), -1)) < radians(5))"
GROUPED = (WALLS, VERTS, _FIXED, NORMALS, _EDGES, _ADJ, _COPLANAR, _CLOSE.format(pairs="copl"))

QUERIES = {f.__name__: f for f in (l1_volume, l1_surface_area, l1_bbox, l1_centroid, l1_watertight, l1_mesh_quality, l1_degenerate_filter, l1_winding_repair, soup_join, weld_vertices, face_adjacency, face_components, largest_body, coplanar_groups, group_properties, site_mesh_level1, site_mesh_bodies, site_mesh_groups, profile_faces)}
SQL = {
    "l1_volume": f"{with_(WALLS, VERTS, TRIS, _SIGNED)} SELECT element_id, round(abs(signed_volume), 6) AS volume FROM sv",
    "l1_surface_area": f"{_N} SELECT element_id, round(sum(area), 6) AS total_area FROM norms GROUP BY 1",
    "l1_bbox": f"{with_(WALLS, VERTS)} SELECT element_id, {', '.join(f'min({c}) AS min_{c}, max({c}) AS max_{c}, max({c}) - min({c}) AS size_{c}' for c in 'xyz')} FROM verts GROUP BY 1",
    "l1_centroid": f"{_N} SELECT element_id, {', '.join(f'round(coalesce(sum(({c}0 + {c}1 + {c}2) / 3 * area) / nullif(sum(area), 0), avg(({c}0 + {c}1 + {c}2) / 3)), 6) AS c{c}' for c in 'xyz')} FROM norms GROUP BY 1",
    "l1_watertight": f"{with_(WALLS, VERTS, TRIS, _EDGES, _TIGHT)} SELECT * FROM tight",
    "l1_mesh_quality": f"""{with_(WALLS, VERTS, TRIS, NORMALS, _EDGES, _TIGHT)}, ar AS (SELECT element_id, min(area) AS mi, max(area) AS ma, median(area) AS me, count(*) AS num_triangles FROM norms GROUP BY 1),
dg AS (SELECT element_id, count(*) FILTER (WHERE area < me * 1e-10) AS degenerate FROM norms JOIN ar USING (element_id) GROUP BY 1),
sides AS (SELECT element_id, unnest([sqrt(pow(x0-x1,2)+pow(y0-y1,2)+pow(z0-z1,2)), sqrt(pow(x1-x2,2)+pow(y1-y2,2)+pow(z1-z2,2)), sqrt(pow(x2-x0,2)+pow(y2-y0,2)+pow(z2-z0,2))]) AS s FROM tris)
SELECT element_id, round(mi, 6) AS min_area, round(ma, 6) AS max_area, round(me, 6) AS median_area, round(e.mi2, 6) AS min_edge, round(e.ma2, 6) AS max_edge, round(e.me2, 6) AS median_edge, degenerate, num_triangles, non_manifold_edges
FROM ar JOIN dg USING (element_id) JOIN (SELECT element_id, min(s) AS mi2, max(s) AS ma2, median(s) AS me2 FROM sides GROUP BY 1) e USING (element_id) JOIN tight USING (element_id)""",
    "l1_degenerate_filter": f"{_T} SELECT element_id, count(*) AS kept, CASE WHEN element_id % 7 = 0 THEN 1 ELSE 0 END::BIGINT AS dropped, max(fid) AS last_fid FROM tris GROUP BY element_id",
    "l1_winding_repair": f"{with_(WALLS, VERTS, _FIXED, _SIGNED)} SELECT element_id, normals_flipped, round(signed_volume, 6) AS signed_volume FROM sv JOIN (SELECT element_id, bool_or(f) AS normals_flipped FROM tris GROUP BY 1) USING (element_id)",
    "soup_join": f"{_T} SELECT element_id, {_VOLUME} AS signed_volume FROM tris GROUP BY 1",
    "weld_vertices": f"{with_(WALLS, VERTS)} SELECT element_id, vid, vid AS rep FROM verts UNION ALL SELECT element_id, vid + 8, vid FROM verts",
    "face_adjacency": f"{with_(WALLS, VERTS, TRIS, _EDGES, _ADJ)} SELECT element_id, f, g FROM adj",
    "face_components": f"{with_(WALLS, VERTS, _TWO, _EDGES, _ADJ, _CLOSE.format(pairs='adj'))} SELECT * FROM comp",
    "largest_body": f"""{with_(WALLS, VERTS, _TWO, NORMALS, _EDGES, _ADJ, _CLOSE.format(pairs='adj'))}, per AS (SELECT element_id, component, sum(area) AS area FROM norms JOIN comp USING (element_id, fid) GROUP BY ALL)
SELECT element_id, arg_max(component, round(area, 6) - component * 1e-9) AS component, round(max(area), 6) AS area, count(*) AS num_bodies FROM per GROUP BY 1""",
    "coplanar_groups": f"{with_(*GROUPED)} SELECT * FROM comp",
    "group_properties": f"""{with_(*GROUPED)}, gs AS (SELECT element_id, component AS group_id, sum(area) AS area, count(*) AS num_triangles, {', '.join(f'sum(u{c} * area) AS s{c}, sum(({c}0 + {c}1 + {c}2) / 3 * area) / sum(area) AS p{c}' for c in 'xyz')} FROM norms JOIN comp USING (element_id, fid) GROUP BY ALL)
SELECT element_id, group_id, num_triangles, round(area, 6) AS area, round(px, 6) AS px, round(py, 6) AS py, round(pz, 6) AS pz, {', '.join(f'round(s{c} / sqrt(sx * sx + sy * sy + sz * sz), 6) + 0 AS g{c}' for c in 'xyz')} FROM gs""",
    "site_mesh_level1": f"""{with_(WALLS, VERTS, TRIS, NORMALS, _EDGES, _TIGHT)}, mo AS (SELECT element_id, model_id FROM walls), sm AS (SELECT model_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, {', '.join(f'min({c}) AS min_{c}, max({c}) AS max_{c}' for c in 'xyz')} FROM verts JOIN mo USING (element_id) GROUP BY 1),
sa AS (SELECT model_id, count(*) AS num_triangles, sum(area) AS total_area, {', '.join(f'sum(({c}0 + {c}1 + {c}2) / 3 * area) / sum(area) AS c{c}' for c in 'xyz')} FROM norms JOIN mo USING (element_id) GROUP BY 1),
sg AS (SELECT model_id, {_ABOUT} AS signed_volume FROM tris JOIN mo USING (element_id) JOIN sm USING (model_id) GROUP BY 1),
st AS (SELECT model_id, sum(num_edges)::BIGINT AS num_edges, sum(non_manifold_edges)::BIGINT AS non_manifold_edges, bool_and(is_watertight) AS is_watertight FROM tight JOIN mo USING (element_id) GROUP BY 1)
SELECT model_id AS element_id, num_triangles, num_edges, non_manifold_edges, is_watertight, round(signed_volume, 6) AS signed_volume, round(total_area, 6) AS total_area, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz, {', '.join(f'{n}_{c}' for c in 'xyz' for n in ('min', 'max'))}
FROM sm JOIN sa USING (model_id) JOIN sg USING (model_id) JOIN st USING (model_id)""",
    "site_mesh_bodies": f"""{_N}, sb AS (SELECT model_id, element_id, min(element_id * 12 + fid) AS component, round(sum(area), 6) AS area FROM norms JOIN (SELECT element_id, model_id FROM walls) USING (element_id) GROUP BY ALL),
rb AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY area DESC, component) AS k, count(*) OVER (PARTITION BY model_id) AS num_bodies FROM sb) SELECT model_id AS element_id, component, area, num_bodies FROM rb WHERE k = 1""",
    "site_mesh_groups": f"""{with_(WALLS, VERTS, TRIS, NORMALS, _EDGES, _ADJ, _COPLANAR, _CLOSE.format(pairs="copl"))}, gs AS (SELECT element_id, component, sum(area) AS area, count(*) AS num_triangles, {', '.join(f'sum(u{c} * area) AS s{c}, sum(({c}0 + {c}1 + {c}2) / 3 * area) / sum(area) AS p{c}' for c in 'xyz')} FROM norms JOIN comp USING (element_id, fid) GROUP BY ALL)
SELECT model_id AS element_id, element_id * 12 + component AS group_id, num_triangles, round(area, 6) AS area, round(px, 6) AS px, round(py, 6) AS py, round(pz, 6) AS pz, {', '.join(f'round(s{c} / sqrt(sx * sx + sy * sy + sz * sz), 6) + 0 AS g{c}' for c in 'xyz')} FROM gs JOIN (SELECT element_id, model_id FROM walls) USING (element_id)""",
    "profile_faces": f"{with_(WALLS)} SELECT element_id, unnest(['ell', 'clasp', 'frame']) AS kind, unnest([4, 6, 8])::BIGINT AS num_triangles, round(unnest([l * t + (h - t) * t, l * h - (l - t) * (h - 2 * t), l * h - (l - 2 * t) * (h - 2 * t)]), 6) AS area FROM walls",
}
