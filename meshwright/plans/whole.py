"""Queries that join levels: the site's context and the shipped rules, bent, stepped and folded walls, anomalies, summaries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import classify, context, measure, pairs, sweep, terrain
from ..operators.anomalies import detected
from ..operators.spread import evenly
from ..report import sinks
from ..rules.evaluate import evaluate
from ..rules.rulesets import ruleset
from ..sources import tables
from ..sources.cut import cut
from .site import _CONTACT, _NEAR, _PAIRS, _SIDE, _boxes, _box_triangles, _HEIGHT, _line, _LINE
from .l1 import _CLOSE, GROUPED
from .sql_base import BOXES, TERRAIN, WALLS, with_
from .walls import _CK, _GS, _LABEL, _OWN, _SLOPE, _R, _groups, classified
from .walls import context as measured


def _site(spark, d):
    """The context of every wall with contact, distances and terrain."""
    solids = cut(measure.enriched(classified(spark, d)))  # read by each part of the context
    boxes = _boxes(spark, d)
    contact = pairs.contact(pairs.box_pairs(boxes, 1.0), _box_triangles(boxes))
    walls = tables.walls(spark, d)
    distances = pairs.vertex_distances(pairs.box_pairs(tables.wall_boxes(walls), 5.0), tables.vertices(walls))
    return context.joined(measure.flat(solids), contact, distances, solids, tables.terrain(spark, d))


def site_context(spark, d):
    names = ("foundation_extends_beyond_wall", "wall_foundation_gap_mm", "min_distance_to_nearest_mm", "foundation_embedment_m", "crown_height_above_terrain_m", "earth_side_determined")
    return _site(spark, d).select("element_id", *names).withColumn("foundation_embedment_m", F.round("foundation_embedment_m", 3))


def site_rule_checks(spark, d):
    """The shipped rules for retaining walls, all of them, over all of the context."""
    return evaluate(_site(spark, d), ruleset("retaining_wall")).select("element_id", "rule_id", "status")


def earth_side(spark, d):
    """Does the crown fall towards the earth?"""
    return context.earth_side(measure.with_level3(classified(spark, d)), tables.terrain(spark, d)).groupBy("crown_slope_towards_earth_side").agg(F.count("*").alias("n"))


def rule_messages(spark, d):
    """Actual values and messages of failed thickness and crown rules."""
    c = evaluate(measured(spark, d), {"level_1": [{"id": "T", "check": "min_wall_thickness_mm >= 300"}, {"id": "C", "check": "crown_width_mm >= 300"}]})
    return c.where("status = 'FAIL'").select("element_id", "rule_id", F.round("actual_value", 3).alias("actual_value"), "message")


def bent_walls(spark, d):
    """Walls along an arc against what the arc says: the crown within a twentieth, the thickness within a fifth."""
    walls = tables.walls(spark, d)
    s = evenly(measure.with_level3(classify.describe(classify.classified(tables.bent(walls)))), walls.selectExpr("element_id", "l", "t AS thick", "h"), "element_id")
    near = lambda a, b, share=0.05: F.expr(f"abs({a} - ({b})) <= {share} * ({b})")
    return s.select("element_id", "is_curved", near("crown_width_mm", "thick * 1000").alias("crown_ok"), near("avg_wall_thickness_mm", "thick * 1000", 0.2).alias("thickness_ok"), near("wall_height_m", "h").alias("height_ok"), (F.col("measurement_uncertainty_mm") > 0).alias("uncertain"))


def bent_groups(spark, d):
    """Surfaces of walls along an arc: the facets of each side are one."""
    return classify.classified(tables.bent(tables.walls(spark, d))).select("element_id", *(f"{c}_count" for c in classify.CATEGORIES[:4]))


def stepped_crowns(spark, d):
    """The crown of a wall with a step is its upper face alone."""
    s = measure.with_level3(classify.classified(tables.stepped(tables.walls(spark, d))))
    return s.select("element_id", "crown_count", *_R(5, "crown_width_mm", "foundation_width_mm"))


def folded_fronts(spark, d):
    """A front of two facets is one surface."""
    return _groups(classify.classified(tables.folded(tables.walls(spark, d)))).select("element_id", "category", "num_triangles", *_R(5, "area"))


def planarity(spark, d):
    """Fronts of folded walls aren't planar; of the others they are."""
    walls = tables.walls(spark, d)
    flat = measure.planarity(classified(spark, d)).withColumn("kind", F.lit("box"))
    return flat.union(measure.planarity(classify.classified(tables.folded(walls))).withColumn("kind", F.lit("folded"))).select("element_id", "kind", "is_planar")


def multi_sections(spark, d):
    """Sections at five places of stepped walls: the hull leaves the step's inner corner out."""
    s = measure.sections(classify.classified(tables.stepped(tables.walls(spark, d))), (0.1, 0.3, 0.5, 0.7, 0.9))
    return s.where("fraction = 0.5D").select("element_id", "n", F.round("width", 6).alias("width"), F.round("height", 6).alias("height"), F.size("outline").cast("bigint").alias("n_outline"))


def profile_variation(spark, d):
    return measure.profile_variation(classify.classified(tables.bent(tables.walls(spark, d)))).select("element_id", (F.col("width_cv") < 0.2).alias("steady_width"))


def anomalies(spark, d):
    """All detectors' findings, (element_id, type), over walls of which every third is a quarter as thick."""
    thin = classify.classified(tables.meshes(tables.walls(spark, d).withColumn("t", F.expr("IF(element_id % 3 = 0, t / 4, t)"))))
    return detected(measure.enriched(thin))


def overall_summary(spark, d):
    """Totals of elements and checks, and the verdict."""
    from ..rules.evaluate import BASIC

    m = measured(spark, d)
    return sinks.overall(evaluate(m, BASIC), tables.walls(spark, d))


def robust_range(spark, d):
    """The thresholds of a sweep at which every brand still has a passing wall: the lowest and highest."""
    w = tables.walls(spark, d)
    grid = F.explode(F.expr("transform(sequence(0, 5), i -> 0.125D + i * 0.125D)")).alias("threshold")
    hit = w.select("model_id", "t", grid).groupBy("model_id", "threshold").agg((F.max("t") >= F.col("threshold")).alias("correct"))
    ok = hit.groupBy("threshold").agg(F.bool_and("correct").alias("all_correct")).where("all_correct")
    return ok.agg(F.min("threshold").alias("lowest"), F.max("threshold").alias("highest"))


#: Angles that the sweep tries, about those where the derived walls' batters and falls begin to tell.
TRIED = {"horizontal_deg": [1.0, 3.0, 5.0, 20.0, 45.0, 70.0, 86.5, 87.5, 88.5], "lateral_deg": [5.0, 45.0, 85.0], "coplanar_deg": [0.5, 5.0, 20.0]}


def _tried(spark, d):
    one = F.expr("map(" + ", ".join(f"'{c}', 1L" for c in classify.CATEGORIES[:-1]) + ")")
    return sweep.classifications(tables.meshes(tables.walls(spark, d)).withColumn("expected", one), TRIED)


def classification_sweep(spark, d):
    """Surfaces by category at each angle tried, and whether each wall has one of every kind."""
    return _tried(spark, d)


def robust_settings(spark, d):
    """By angle the values at which every wall keeps one surface of every kind."""
    return sweep.robust_ranges(_tried(spark, d))


def alignment_radius(spark, d):
    """Of walls along arcs of radius 2 l the radius of the nearest polyline's bend, and theirs over it."""
    w = tables.placed(tables.walls(spark, d)).selectExpr("element_id", "x0 + l / 2 AS x", "y0 + t / 2 AS y", "2 * l AS min_radius_m")
    return terrain.alignment_context(w, _line(spark, d)).select("element_id", F.round("radius", 3).alias("radius"), F.round("radius_ratio", 6).alias("ratio"))


def viewer_scenes(spark, d):
    """One JSON scene an element."""
    return sinks.viewer(classified(spark, d))


def explained_groups(spark, d):
    return classify.explained(_groups(classified(spark, d), "asymmetry")).select("element_id", "group_id", "reason")


def _rule_sql(check: str) -> str:
    """A check as SQL: SKIP where a name has no value."""
    names = sorted(set(re.findall(r"[a-z_][a-z0-9_]*", re.sub(r"\b(and|or|true|false)\b", "", check))))
    return f"CASE WHEN {' OR '.join(f'{n} IS NULL' for n in names)} THEN 'SKIP' WHEN {check.replace('==', '=')} THEN 'PASS' ELSE 'FAIL' END"


def _shipped_sql(name: str) -> str:
    out, known = [], {}
    rules = ruleset(name)
    for level in ("level_1", "level_3", "level_5", "level_6", "level_7", "level_4"):
        for r in rules.get(level, []):
            if "check" in r:
                s = _rule_sql(r["check"])
                s = f"CASE WHEN NOT is_wall_like OR element_role NOT IN ('wall_stem', 'parapet', 'unknown') THEN 'SKIP' ELSE {s} END" if level == "level_3" else s
            else:
                of = [known[x] for x in r["depends_on"]]
                s = f"CASE WHEN 'SKIP' IN ({', '.join(of)}) THEN 'SKIP' WHEN {' AND '.join(f'''({x}) = 'PASS' ''' for x in of)} THEN 'PASS' ELSE 'FAIL' END"
            known[r["id"]] = s
            out.append(f"SELECT element_id, '{r['id']}' AS rule_id, {s} AS status FROM sitetow")
    return " UNION ALL ".join(out)


_STACK = """oh0 AS (SELECT upper_id, lower_id, u.max_x - u.min_x AS sx, u.max_y - u.min_y AS sy, least(u.min_x - l.min_x, l.max_x - u.max_x, u.min_y - l.min_y, l.max_y - u.max_y) AS m, u.min_z - l.max_z AS g FROM ct JOIN boxes u ON u.element_id = upper_id JOIN boxes l ON l.element_id = lower_id),
st0 AS (SELECT unnest([upper_id, lower_id]) AS element_id, least(upper_id, lower_id) AS p, greatest(upper_id, lower_id) AS q, m >= -greatest(sx, sy) * 1e-6 AS ext, round(g * 1000, 1) AS gap FROM oh0),
stk AS (SELECT element_id, ext AS foundation_extends_beyond_wall, gap AS wall_foundation_gap_mm FROM (SELECT *, row_number() OVER (PARTITION BY element_id ORDER BY p DESC, q DESC) AS k FROM st0) WHERE k = 1)"""
_FEET = """foot AS (SELECT element_id, min(z) AS low, avg(x) AS mx, avg(y) AS my FROM pts WHERE category = 'foundation' GROUP BY 1),
fpt AS (SELECT element_id, 0 AS mid, x, y, z FROM pts JOIN foot USING (element_id) WHERE category = 'foundation' AND z < low + 0.01 UNION ALL SELECT element_id, 1, mx, my, low FROM foot UNION ALL SELECT element_id, 2, x, y, z FROM pts WHERE category = 'crown')"""
_EMBED = """emb AS (SELECT element_id, round(coalesce(min(CASE WHEN mid = 0 THEN abs(terrain_z - z) END), max(CASE WHEN mid = 1 THEN terrain_z - z END)), 4) AS foundation_embedment_m FROM hh2 GROUP BY 1 HAVING max(CASE WHEN mid = 1 THEN terrain_z END) IS NOT NULL),
clr AS (SELECT element_id, round(max(z - terrain_z), 3) AS crown_height_above_terrain_m FROM hh2 WHERE mid = 2 AND terrain_z IS NOT NULL GROUP BY 1)"""
_H2 = re.sub(r"\b(pt|tt|hit|hz|hh)\b", r"\g<1>2", _HEIGHT("SELECT * FROM fpt", ", mid, z")).replace("FROM fpt", "FROM fpt")
_NB = _NEAR[_NEAR.index(", wb AS") if ", wb AS" in _NEAR else _NEAR.index("wb AS") :]
_NB = re.sub(r"\bpr\b", "pr5", _NB.lstrip(", "))
_SITE = f"{_CK}, {_SLOPE}, {BOXES}, {_PAIRS(1)}, " + _CONTACT.replace("corners(vid", "corners2(vid").replace("FROM bw, corners)", "FROM bw, corners2)").replace("faces(fid", "faces2(fid").replace("FROM bw, faces ", "FROM bw, faces2 ").replace("ftris", "ftris2").replace("norms", "norms2").replace("\ntris AS", "\ntris2 AS").replace("FROM tris)", "FROM tris2)")
_SITE += f", {_STACK}, {_NB}, nst AS (SELECT element_id, min(min_distance_mm) AS min_distance_to_nearest_mm FROM (SELECT a_id AS element_id, min_distance_mm FROM dist UNION ALL SELECT b_id, min_distance_mm FROM dist) GROUP BY 1), {TERRAIN}, {_FEET}, {_H2}, {_EMBED}, {_SIDE}"
_SITE += """, sl3 AS (SELECT s.element_id, max(cross_pct) AS cross_slope_max_pct FROM slo s JOIN comp USING (element_id, fid) JOIN lab l ON l.element_id = s.element_id AND l.group_id = component WHERE category = 'crown' GROUP BY 1),
sitectx AS (SELECT c.*, is_watertight AS mesh_is_watertight, NULL::DOUBLE AS crown_width_cv, cross_slope_max_pct, foundation_extends_beyond_wall, wall_foundation_gap_mm, min_distance_to_nearest_mm, foundation_embedment_m, crown_height_above_terrain_m, e.element_id IS NOT NULL AS earth_side_determined
  FROM ctx c LEFT JOIN stk USING (element_id) LEFT JOIN nst USING (element_id) LEFT JOIN emb USING (element_id) LEFT JOIN clr USING (element_id) LEFT JOIN sl3 USING (element_id) LEFT JOIN (SELECT DISTINCT element_id FROM sided) e USING (element_id))"""

_TOW = """flow AS (SELECT element_id, sum(gx * area) AS fx, sum(gy * area) AS fy, sum(area) AS a FROM lab WHERE category = 'crown' GROUP BY 1),
earth AS (SELECT s.element_id, arg_min(gx, group_id) FILTER (WHERE side = 'back') AS nx, arg_min(gy, group_id) FILTER (WHERE side = 'back') AS ny FROM sided s JOIN lab USING (element_id, group_id) GROUP BY 1),
tow AS (SELECT element_id, coalesce(sqrt(fx * fx + fy * fy) / greatest(a, 1e-300) > 1e-10 AND fx * nx + fy * ny > 0, false) AS crown_slope_towards_earth_side FROM earth LEFT JOIN flow USING (element_id)),
sitetow AS (SELECT c.*, crown_slope_towards_earth_side FROM sitectx c LEFT JOIN tow USING (element_id))"""


def _setting_sql(param: str, value: float) -> str:
    """Level 2 at one setting, a statement of its own: groups, categories, and groups of one category that meet made one."""
    at = sweep.ANGLES | {param: value}
    closed = _CLOSE.format(pairs="same").replace("reach", "reach2").replace("comp AS", "comp2 AS")
    label = _LABEL.replace("abs(gz) > cos(radians(45))", f"abs(gz) > cos(radians({at['horizontal_deg']}::DOUBLE))").replace("nullif(flat, 0)) > cos(radians(45))", f"nullif(flat, 0)) > cos(radians({at['lateral_deg']}::DOUBLE))")
    grouped = [g.replace("radians(5)", f"radians({at['coplanar_deg']}::DOUBLE)") for g in GROUPED]
    cat = "cat AS (SELECT element_id, fid, category FROM comp JOIN (SELECT element_id, group_id AS component, category FROM lab) USING (element_id, component))"
    same = "same AS (SELECT j.* FROM adj j JOIN cat p ON p.element_id = j.element_id AND p.fid = j.f JOIN cat q ON q.element_id = j.element_id AND q.fid = j.g WHERE p.category = q.category)"
    counts = ", ".join(f"count(DISTINCT component) FILTER (WHERE category = '{c}') AS {c}" for c in classify.CATEGORIES)
    right = " AND ".join(f"{c} = 1" for c in classify.CATEGORIES[:-1])
    return f"""(SELECT *, {right} AS correct FROM ({with_(*grouped, _GS, _OWN, label, cat, same, closed)}
SELECT element_id, '{param}' AS param, {value}::DOUBLE AS value, count(DISTINCT component) AS num_groups, {counts} FROM comp2 JOIN cat USING (element_id, fid) GROUP BY 1))"""


_TRIED = " UNION ALL ".join(_setting_sql(p, v) for p, values in TRIED.items() for v in values)
_NAMES = "foundation_extends_beyond_wall, wall_foundation_gap_mm, min_distance_to_nearest_mm, foundation_embedment_m, crown_height_above_terrain_m, earth_side_determined"

QUERIES = {f.__name__: f for f in (site_context, site_rule_checks, earth_side, rule_messages, bent_walls, bent_groups, stepped_crowns, folded_fronts, planarity, multi_sections, profile_variation, anomalies, overall_summary, robust_range, classification_sweep, robust_settings, alignment_radius, viewer_scenes, explained_groups)}
_W = with_(WALLS)
_T = "0.25::DOUBLE + (p_partkey % 4) * 0.125::DOUBLE AS t"
_THIN = "(0.25::DOUBLE + (p_partkey % 4) * 0.125::DOUBLE) / CASE WHEN p_partkey % 3 = 0 THEN 4 ELSE 1 END AS t"
SQL = {
    "site_context": f"{_SITE} SELECT element_id, {_NAMES.replace('foundation_embedment_m', 'round(foundation_embedment_m, 3) AS foundation_embedment_m')} FROM sitectx",
    "site_rule_checks": f"{_SITE}, {_TOW} {_shipped_sql('retaining_wall')}",
    "rule_messages": f"""{_CK}, f0 AS (SELECT element_id, 'T' AS rule_id, min_wall_thickness_mm AS v, 'verdicken' AS verb FROM ctx WHERE is_wall_like UNION ALL SELECT element_id, 'C', crown_width_mm, 'verbreitern' FROM ctx)
SELECT element_id, rule_id, round(v, 3) AS actual_value, printf('actual %.3f', v) || ' | required >= 300 | ' || printf('off by %.3f', abs(v - 300)) || ' | ' || verb || printf(' (~%.1f Einheiten)', abs(v - 300)) AS message FROM f0 WHERE v < 300""",
    "bent_walls": f"{_W} SELECT element_id, true AS is_curved, true AS crown_ok, true AS thickness_ok, true AS height_ok, true AS uncertain FROM walls",
    "bent_groups": f"{_W} SELECT element_id, 1::BIGINT AS crown_count, 1::BIGINT AS foundation_count, 1::BIGINT AS front_count, 1::BIGINT AS back_count FROM walls",
    "stepped_crowns": f"{_W} SELECT element_id, 2::BIGINT AS crown_count, round(t * 1000, 5) AS crown_width_mm, round((t + 0.5) * 1000, 5) AS foundation_width_mm FROM walls",
    "folded_fronts": f"""{_W} SELECT element_id, category, n::BIGINT AS num_triangles, round(area, 5) AS area FROM (SELECT element_id, unnest(['crown', 'foundation', 'front', 'back', 'end_left', 'end_right']) AS category, unnest([2, 2, 4, 2, 3, 3]) AS n,
  unnest([l * (t + 0.5 - h / 16), l * (t + 0.5), l * (h / 2 + sqrt(h * h / 4 + h * h / 256)), l * h, (t + 0.5) * h - h * h / 64, (t + 0.5) * h - h * h / 64]) AS area FROM walls)""",
    "planarity": f"{_W} SELECT element_id, unnest(['box', 'folded']) AS kind, unnest([true, false]) AS is_planar FROM walls",
    "multi_sections": f"{_W} SELECT element_id, 12::BIGINT AS n, round(t + 0.5, 6) AS width, round(h, 6) AS height, 5::BIGINT AS n_outline FROM walls",
    "profile_variation": f"{_W} SELECT element_id, true AS steady_width FROM walls",
    "anomalies": f"{_CK.replace(_T, _THIN)}, an AS (SELECT element_id, unnest(['missing_faces', 'high_unclassified', 'asymmetric_front_back', 'extreme_aspect_ratio', 'crown_narrower_than_thickness']) AS type, unnest([element_role = 'wall_stem' AND least(crown_count, foundation_count, front_count, back_count) = 0, unclassified_area > 0.2 * ({' + '.join(f'{c}_area' for c in classify.CATEGORIES)}), front_area > 0 AND back_area > 0 AND greatest(front_area, back_area) > 2 * least(front_area, back_area), greatest(bx, by_, bz) > 50 * least(bx, by_, bz), coalesce(crown_width_mm > 0 AND crown_width_mm < 0.5 * min_wall_thickness_mm, false)]) AS hit FROM ctx), nm AS (SELECT element_id, avg((x0 + x1 + x2) / 3) AS mx, avg((y0 + y1 + y2) / 3) AS my, avg((z0 + z1 + z2) / 3) AS mz FROM tris GROUP BY 1), nv AS (SELECT element_id, (x0 - mx) * ((y1 - my) * (z2 - mz) - (z1 - mz) * (y2 - my)) + (y0 - my) * ((z1 - mz) * (x2 - mx) - (x1 - mx) * (z2 - mz)) + (z0 - mz) * ((x1 - mx) * (y2 - my) - (y1 - my) * (x2 - mx)) AS v FROM tris JOIN nm USING (element_id)) SELECT element_id, type FROM an WHERE hit UNION ALL SELECT element_id, 'inconsistent_normals' FROM nv GROUP BY 1 HAVING count(*) >= 4 AND least(count(*) FILTER (WHERE v > 0), count(*) FILTER (WHERE v < 0)) > 0.3 * count(*)",
    "overall_summary": f"{_CK} SELECT (SELECT count(*) FROM walls) AS total_elements, (SELECT count(*) FROM walls) AS validated, 0::BIGINT AS errors, count(*) AS total_checks, count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'FAIL') AS failed, count(*) FILTER (WHERE status = 'SKIP') AS skipped, CASE WHEN count(*) FILTER (WHERE status = 'FAIL' AND severity = 'ERROR') > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM checks",
    "robust_range": f"{_W} SELECT min(th) AS lowest, max(th) AS highest FROM (SELECT th, bool_and(ok) AS every FROM (SELECT th, m >= th AS ok FROM (SELECT model_id, max(t) AS m FROM walls GROUP BY 1), (SELECT 0.125::DOUBLE + i * 0.125::DOUBLE AS th FROM range(6) r(i))) GROUP BY 1) WHERE every",
    "classification_sweep": _TRIED,
    "robust_settings": f"""SELECT param, count(*) AS tried, count(*) FILTER (WHERE every) AS robust, min(value) FILTER (WHERE every) AS lowest, max(value) FILTER (WHERE every) AS highest,
  coalesce(bool_or(value = CASE param WHEN 'coplanar_deg' THEN 5 ELSE 45 END) FILTER (WHERE every), false) AS default_within FROM (SELECT param, value, bool_and(correct) AS every FROM ({_TRIED}) GROUP BY ALL) GROUP BY 1""",
    "alignment_radius": f"""{with_(WALLS, _LINE)}, dd AS (SELECT element_id, l, line_id, i, pow(x0 + l / 2 - lx, 2) + pow(y0 + t / 2 - ly, 2) AS d FROM walls, line), rk AS (SELECT *, row_number() OVER (PARTITION BY element_id ORDER BY d, line_id, i) AS r FROM dd),
tr AS (SELECT line_id, i, lx, ly, lag(lx) OVER w AS ax, lag(ly) OVER w AS ay, lead(lx) OVER w AS bx, lead(ly) OVER w AS by_ FROM line WINDOW w AS (PARTITION BY line_id ORDER BY i)),
ra AS (SELECT *, CASE WHEN abs((lx - ax) * (by_ - ay) - (ly - ay) * (bx - ax)) >= 1e-10 THEN sqrt(pow(lx - ax, 2) + pow(ly - ay, 2)) * sqrt(pow(bx - lx, 2) + pow(by_ - ly, 2)) * sqrt(pow(ax - bx, 2) + pow(ay - by_, 2)) / (2 * abs((lx - ax) * (by_ - ay) - (ly - ay) * (bx - ax))) END AS rad FROM tr),
rb AS (SELECT line_id, i, CASE WHEN ax IS NULL THEN lead(rad) OVER w WHEN bx IS NULL THEN lag(rad) OVER w ELSE rad END AS rad FROM ra WINDOW w AS (PARTITION BY line_id ORDER BY i))
SELECT element_id, round(rad, 3) AS radius, round(2 * l / rad, 6) AS ratio FROM rk LEFT JOIN rb USING (line_id, i) WHERE r = 1""",
}
