"""L2 to L4 queries over the derived walls: classification, measurements, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify, measure, solid
from ..rules.evaluate import BASIC, evaluate, summary
from ..sources import tables
from .l1 import _EDGES, _SIGNED, _TIGHT, GROUPED
from .sql_base import with_


def classified(spark, d):
    """Level 2 of the derived walls, a row a wall: no shuffle, one scan."""
    return classify.classified(tables.meshes(tables.walls(spark, d)))


def context(spark, d):
    """The flat context of the rules, a row a wall."""
    return measure.context(classified(spark, d))


_R = lambda digits, *names: [F.expr(f"round({n}, {digits}) + 0D").alias(n) for n in names]


def _groups(solids, *more):
    """A row a surface group."""
    return solids.select("element_id", *more, F.inline(F.transform("groups", lambda g: F.struct(*(g[c].alias(c) for c in ("group_id", "area", "num_triangles", "px", "py", "pz", "gx", "gy", "gz", "category"))))))


def wall_axis_pca(spark, d):
    return solid.with_axis(solid.faced(tables.meshes(tables.walls(spark, d)))).select("element_id", *_R(6, "ax", "ay"))


def face_labels(spark, d):
    return _groups(classified(spark, d)).select("element_id", "group_id", "category")


def category_summary(spark, d):
    return classified(spark, d).select("element_id", *(f"{c}_count" for c in classify.CATEGORIES), *_R(6, *(f"{c}_area" for c in classify.CATEGORIES)))


def element_role(spark, d):
    return classify.describe(classified(spark, d)).select("element_id", "is_wall_like", "element_role")


def role_histogram(spark, d):
    return classify.describe(classified(spark, d)).groupBy("element_role").agg(F.count("*").alias("n"))


def classification_confidence(spark, d):
    return classify.describe(classified(spark, d)).select("element_id", "confidence")


def _level3(spark, d, *names):
    return measure.with_level3(classified(spark, d)).select("element_id", *_R(5, *names))


def crown_width(spark, d):
    return _level3(spark, d, "crown_width_mm", "foundation_width_mm")


def crown_slope(spark, d):
    return _level3(spark, d, "crown_slope_percent")


def wall_thickness(spark, d):
    return _level3(spark, d, "min_wall_thickness_mm", "avg_wall_thickness_mm")


def front_inclination(spark, d):
    return _level3(spark, d, "front_inclination_deg", "front_inclination_ratio")


def wall_height(spark, d):
    return measure.with_level3(classified(spark, d)).select("element_id", "wall_height_m", "wall_length_m", "foundation_width_ratio")


def plumbness(spark, d):
    return measure.with_plumbness(classified(spark, d)).where("front_plumbness_deg IS NOT NULL").select("element_id", "front_plumbness_deg", "is_plumb")


def triangle_slopes(spark, d):
    s = measure.with_slopes(classified(spark, d)).select("element_id", F.inline("slopes"))
    return s.select("element_id", "fid", *_R(5, "slope_pct", "cross_pct", "long_pct"))


def surface_slopes(spark, d):
    s = measure.with_surface_slopes(measure.with_slopes(classified(spark, d))).where("cross_slope_avg_pct IS NOT NULL")
    return s.select("element_id", *_R(5, "cross_slope_avg_pct", "cross_slope_max_pct", "long_slope_avg_pct", "long_slope_max_pct"))


def rule_checks(spark, d):
    return evaluate(context(spark, d), BASIC).select("element_id", "seq", "rule_id", "status", "severity")


def check_summary(spark, d):
    return summary(evaluate(context(spark, d), BASIC))


def rule_compliance(spark, d):
    c = evaluate(context(spark, d), BASIC)
    return c.groupBy("rule_id").agg(*(F.count_if(F.col("status") == s).alias(n) for s, n in (("PASS", "passed"), ("FAIL", "failed"), ("SKIP", "skipped"))))


def composite_rules(spark, d):
    c = evaluate(context(spark, d), BASIC).where("rule_id LIKE 'L4-%'")
    return c.select("element_id", "rule_id", "status", F.array_join(F.array_sort(F.transform(F.map_entries("actual_map"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("parts"))


def rule_missing_skips(spark, d):
    """Missing values under and, or and chains, and divisions by zero, over order prices (null where below 50,000)."""
    o = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey AS element_id", "IF(o_totalprice < 50000, NULL, o_totalprice) AS price", "CAST(o_custkey % 3 AS DOUBLE) AS part", "o_orderstatus = 'F' AS closed")
    checks = ["price > 100000 and closed", "closed or price > 0", "part > 5 > price", "10 / part > 4", "10 % part == 1", "not closed", "part", "abs(part - 2) < 1", "unknown_name > 1", "(0 - 7) // 2 == 0 - 4", "part.real > 0"]
    rules = {"level_1": [{"id": f"R{i:02d}", "check": c} for i, c in enumerate(checks)]}
    return evaluate(o, rules).select("element_id", "rule_id", "status")


_GS = f"""gs0 AS (SELECT element_id, component AS group_id, sum(area) AS area, count(*) AS num_triangles, {', '.join(f'sum(u{c} * area) AS s{c}, sum(({c}0 + {c}1 + {c}2) / 3 * area) / sum(area) AS p{c}' for c in 'xyz')} FROM norms JOIN comp USING (element_id, fid) GROUP BY ALL),
gs AS (SELECT *, {', '.join(f'coalesce(s{c} / nullif(sqrt(sx * sx + sy * sy + sz * sz), 0), s{c}) AS g{c}' for c in 'xyz')} FROM gs0)"""
_AXIS = """cen AS (SELECT element_id, area AS w, (x0 + x1 + x2) / 3 AS x, (y0 + y1 + y2) / 3 AS y, least(x0, x1, x2) AS lx, greatest(x0, x1, x2) AS hx, least(y0, y1, y2) AS ly, greatest(y0, y1, y2) AS hy FROM norms),
mid AS (SELECT element_id, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, max(hx) - min(lx) AS sx, max(hy) - min(ly) AS sy FROM cen GROUP BY 1),
cov AS (SELECT element_id, sum(w * (x - mx) * (x - mx)) / sum(w) AS xx, sum(w * (x - mx) * (y - my)) / sum(w) AS xy, sum(w * (y - my) * (y - my)) / sum(w) AS yy, any_value(sx) AS sx, any_value(sy) AS sy FROM cen JOIN mid USING (element_id) GROUP BY 1),
eig AS (SELECT *, (xx + yy) / 2 + sqrt(pow((xx - yy) / 2, 2) + xy * xy) AS big, (xx + yy) / 2 - sqrt(pow((xx - yy) / 2, 2) + xy * xy) AS small FROM cov),
vec AS (SELECT *, CASE WHEN xx >= yy THEN big - yy ELSE xy END AS ex, CASE WHEN xx >= yy THEN xy ELSE big - xx END AS ey FROM eig),
vec2 AS (SELECT *, sqrt(ex * ex + ey * ey) AS n, CASE WHEN CASE WHEN abs(ex) >= abs(ey) THEN ex ELSE ey END < 0 THEN -1 ELSE 1 END AS sg FROM vec),
axis AS (SELECT element_id, CASE WHEN big / greatest(small, 1e-12) < 2 OR n = 0 THEN CASE WHEN sx >= sy THEN 1 ELSE 0 END ELSE sg * ex / nullif(n, 0) END::DOUBLE AS ax, CASE WHEN big / greatest(small, 1e-12) < 2 OR n = 0 THEN CASE WHEN sx >= sy THEN 0 ELSE 1 END ELSE sg * ey / nullif(n, 0) END::DOUBLE AS ay FROM vec2)"""
_OWN = _AXIS.replace("cen AS (SELECT element_id, area AS w, (x0 + x1 + x2) / 3 AS x, (y0 + y1 + y2) / 3 AS y, least(x0, x1, x2) AS lx, greatest(x0, x1, x2) AS hx, least(y0, y1, y2) AS ly, greatest(y0, y1, y2) AS hy FROM norms)", "cen AS (SELECT element_id, 1.0::DOUBLE AS w, x, y, x AS lx, x AS hx, y AS ly, y AS hy FROM verts)")
_LABEL = """fr AS (SELECT gs.*, ax, ay, px * ax + py * ay AS along, sqrt(gx * gx + gy * gy) AS flat, -gx * ay + gy * ax AS across FROM gs JOIN axis USING (element_id)),
fx AS (SELECT *, min(along) OVER e AS lo, max(along) OVER e AS hi, least(CASE WHEN max(px) OVER e - min(px) OVER e > 1e-6 THEN max(px) OVER e - min(px) OVER e END, CASE WHEN max(py) OVER e - min(py) OVER e > 1e-6 THEN max(py) OVER e - min(py) OVER e END, CASE WHEN max(pz) OVER e - min(pz) OVER e > 1e-6 THEN max(pz) OVER e - min(pz) OVER e END) AS tol FROM fr WINDOW e AS (PARTITION BY element_id)),
fk AS (SELECT *, CASE WHEN abs(gz) > cos(radians(45)) THEN CASE WHEN gz > 0 THEN 'crown' ELSE 'foundation' END WHEN abs((gx * ax + gy * ay) / nullif(flat, 0)) > cos(radians(45)) THEN CASE WHEN NOT coalesce(least(along - lo, hi - along) < tol, false) THEN 'unclassified' WHEN (gx * ax + gy * ay) / nullif(flat, 0) > 0 THEN 'end_right' ELSE 'end_left' END ELSE CASE WHEN across > 0 THEN '+' ELSE '-' END END AS kind FROM fx),
fa AS (SELECT *, coalesce(sum(area) FILTER (WHERE kind = '+') OVER e, 0) AS ap, coalesce(sum(area) FILTER (WHERE kind = '-') OVER e, 0) AS am, coalesce(sum(abs(across) * area) FILTER (WHERE kind = '+') OVER e, 0) AS dp, coalesce(sum(abs(across) * area) FILTER (WHERE kind = '-') OVER e, 0) AS dm FROM fk WINDOW e AS (PARTITION BY element_id)),
fs AS (SELECT *, coalesce(abs(ap - am) / nullif(ap + am, 0), 0) AS asymmetry FROM fa),
lab AS (SELECT *, CASE WHEN kind IN ('+', '-') THEN CASE WHEN kind = CASE WHEN asymmetry > 1e-6 AND am > ap THEN '-' ELSE '+' END THEN 'front' ELSE 'back' END ELSE kind END AS category FROM fs)"""
_SUM = f"catsum AS (SELECT element_id, {', '.join(f'''count(*) FILTER (WHERE category = '{c}') AS {c}_count, coalesce(sum(area) FILTER (WHERE category = '{c}'), 0) AS {c}_area''' for c in classify.CATEGORIES)}, max(asymmetry) AS asymmetry FROM lab GROUP BY 1)"
_BOX = "box AS (SELECT element_id, max(x) - min(x) AS bx, max(y) - min(y) AS by_, max(z) - min(z) AS bz FROM verts GROUP BY 1)"
_ROLE = f"""rl AS (SELECT *, greatest(bx, by_) AS mx, least(bx, by_) AS mn, bz AS z, greatest(bx, by_) / greatest(least(bx, by_), 1e-6) AS aspect, front_area + back_area AS vert, crown_area + foundation_area AS hor FROM catsum JOIN box USING (element_id)),
rw AS (SELECT *, NOT ((aspect < 1.5 AND z < 0.5 * mx) OR (z < 0.05 * mx AND z < 0.5 * mn)) OR (crown_count > 0 AND foundation_count > 0 AND (front_count > 0 OR back_count > 0) AND vert > 0.3 * hor) AS is_wall_like FROM rl),
roles AS (SELECT *, CASE WHEN z < 0.05 * mx AND z < 0.5 * mn THEN 'slab' WHEN z < mn / 2 AND hor > 2 * vert THEN 'foundation' WHEN aspect < 2 AND z > 0.8 * mx THEN 'column' WHEN z < 1.5 AND mn < 0.5 AND aspect > 3 THEN 'parapet' WHEN aspect > 2 AND vert > 0.3 * hor THEN 'wall_stem' WHEN is_wall_like THEN 'wall_stem' ELSE 'unknown' END AS element_role,
  round(least(1, CASE WHEN crown_count > 0 AND foundation_count > 0 THEN 0.25 WHEN crown_count > 0 OR foundation_count > 0 THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN front_count > 0 AND back_count > 0 THEN 0.25 WHEN front_count > 0 OR back_count > 0 THEN 0.1 ELSE 0 END::DOUBLE
  + 0.2::DOUBLE * (1 - coalesce(unclassified_area / nullif({' + '.join(f'{c}_area' for c in classify.CATEGORIES)}, 0), 0)) + CASE WHEN is_wall_like THEN 0.15 ELSE 0 END::DOUBLE + CASE WHEN asymmetry > 0.05 THEN 0.15 WHEN asymmetry > 0.01 THEN 0.08 ELSE 0 END::DOUBLE), 3) AS confidence FROM rw)"""
_POINTS = """corner AS (SELECT element_id, fid, unnest([{v: a, x: x0, y: y0, z: z0}, {v: b, x: x1, y: y1, z: z1}, {v: c, x: x2, y: y2, z: z2}]) AS p FROM tris),
pts AS (SELECT DISTINCT element_id, category, p.v AS v, p.x AS x, p.y AS y, p.z AS z, p.x * ax + p.y * ay AS along, -p.x * ay + p.y * ax AS across FROM corner JOIN comp USING (element_id, fid) JOIN (SELECT element_id, group_id AS component, category FROM lab) USING (element_id, component) JOIN axis USING (element_id))"""
_pick = lambda f, c, x="across": f"{f} FILTER (WHERE category = '{c}')".replace("?", x)
_mean = lambda c, e: f"sum(CASE WHEN category = '{c}' THEN ({e}) * area ELSE 0 END) / nullif(sum(CASE WHEN category = '{c}' THEN area ELSE 0 END), 0)"
_L3 = f"""p3 AS (SELECT element_id, {', '.join(f'{_pick("min(?)", c)} AS {c}_lo, {_pick("max(?)", c)} AS {c}_hi' for c in ('crown', 'foundation'))},
  {', '.join(f'{_pick("median(?)", c)} AS {c}_mid, {_pick("count(?)", c)} AS {c}_n, {_pick("quantile_cont(?, 0.1)", c)} AS {c}_p10, {_pick("quantile_cont(?, 0.9)", c)} AS {c}_p90' for c in ('front', 'back'))},
  round(max(z) FILTER (WHERE category IN ('front', 'back')) - min(z) FILTER (WHERE category IN ('front', 'back')), 4) AS wall_height_m, round(max(along) - min(along), 4) AS wall_length_m FROM pts GROUP BY 1),
g3 AS (SELECT element_id, {_mean('crown', 'abs(gz)')} AS tilt, {_mean('crown', 'least(tan(acos(least(abs(gz), 1))) * 100, 1e6)')} AS crown_slope_percent, {_mean('front', 'gx')} AS fx, {_mean('front', 'gy')} AS fy, {_mean('front', 'gz')} AS fz FROM lab GROUP BY 1),
m3 AS (SELECT *, sqrt(fx * fx + fy * fy) AS flat, sqrt(fx * fx + fy * fy + fz * fz) AS len, abs(front_mid - back_mid) AS avg_, CASE WHEN front_n >= 4 AND back_n >= 4 THEN CASE WHEN front_mid < back_mid THEN abs(back_p10 - front_p90) ELSE abs(back_p90 - front_p10) END ELSE abs(front_mid - back_mid) END AS min_ FROM p3 JOIN g3 USING (element_id)),
n3 AS (SELECT *, CASE WHEN len > 1e-10 AND flat / len > 1e-10 THEN flat / len ELSE 1 END AS co, CASE WHEN flat < 1e-10 THEN 90 ELSE degrees(atan2(abs(fz), flat)) END::DOUBLE AS deg FROM m3),
level3 AS (SELECT element_id, (crown_hi - crown_lo) / nullif(tilt, 0) * 1000 AS crown_width_mm, (foundation_hi - foundation_lo) * 1000 AS foundation_width_mm, crown_slope_percent, wall_height_m, wall_length_m,
  CASE WHEN min_ = 0 THEN avg_ ELSE min_ END * 1000 * co AS min_wall_thickness_mm, avg_ * 1000 * co AS avg_wall_thickness_mm, deg AS front_inclination_deg,
  CASE WHEN deg < 0.01 THEN 'Infinity'::DOUBLE WHEN deg >= 90 THEN 0 ELSE 1 / tan(radians(deg)) END AS front_inclination_ratio, round((foundation_hi - foundation_lo) * 1000 / nullif(wall_height_m * 1000, 0), 6) AS foundation_width_ratio FROM n3)"""
_TO = lambda *more: with_(*GROUPED, _GS, _OWN, *more)
_FULL = (_LABEL, _SUM, _BOX, _ROLE, _POINTS, _L3)
_r3 = lambda *names: f"{_TO(_LABEL, _POINTS, _L3)} SELECT element_id, {', '.join(f'round({n}, 5) + 0 AS {n}' for n in names)} FROM level3"
_SLOPE = "slo AS (SELECT element_id, fid, area, CASE WHEN abs(uz) < 1e-10 THEN 9000 ELSE sqrt(ux * ux + uy * uy) / abs(uz) * 100 END::DOUBLE AS slope_pct, CASE WHEN abs(uz) < 1e-10 THEN 9000 ELSE abs(-ux * ay + uy * ax) / abs(uz) * 100 END::DOUBLE AS cross_pct, CASE WHEN abs(uz) < 1e-10 THEN 9000 ELSE abs(ux * ax + uy * ay) / abs(uz) * 100 END::DOUBLE AS long_pct FROM norms JOIN axis USING (element_id))"
_three = lambda cond: f"CASE WHEN {cond} THEN 'PASS' ELSE 'FAIL' END"
_wall = lambda cond, need: f"CASE WHEN NOT is_wall_like OR element_role NOT IN ('wall_stem', 'parapet', 'unknown') OR {need} IS NULL THEN 'SKIP' WHEN {cond} THEN 'PASS' ELSE 'FAIL' END"
_all = lambda *s: f"CASE WHEN 'SKIP' IN ({', '.join(s)}) THEN 'SKIP' WHEN {' AND '.join(f'''{x} = 'PASS' ''' for x in s)} THEN 'PASS' ELSE 'FAIL' END"
_CHECKS = f"""{_SIGNED}, vol AS (SELECT element_id, abs(signed_volume) AS volume FROM sv),
ctx AS (SELECT *, bz AS bbox_height_m, least(bx, by_, bz) AS bbox_dim_min_m FROM vol JOIN tight USING (element_id) JOIN roles USING (element_id) LEFT JOIN level3 USING (element_id)),
st AS (SELECT element_id, {_three('volume > 0.1')} AS s0, {_three('is_watertight')} AS s1, {_three('bbox_height_m >= 2.25 AND bbox_height_m <= 4.75')} AS s2,
  {_wall('crown_width_mm >= 300', 'crown_width_mm')} AS s3, {_wall('min_wall_thickness_mm >= 300', 'min_wall_thickness_mm')} AS s4, {_wall('crown_slope_percent BETWEEN 2.5 AND 3.5', 'crown_slope_percent')} AS s5,
  CASE WHEN element_role <> 'wall_stem' OR foundation_width_mm IS NULL OR wall_height_m IS NULL THEN 'SKIP' WHEN foundation_width_mm >= wall_height_m * 100 THEN 'PASS' ELSE 'FAIL' END AS s6,
  {_wall('1 / nullif(bbox_dim_min_m - 0.25, 0) > 2', 'nullif(bbox_dim_min_m - 0.25, 0)')} AS s7, 'SKIP' AS s8 FROM ctx),
st2 AS (SELECT *, {_all('s0', 's1')} AS s9, {_all('s3', 's4', 's5')} AS s10 FROM st), st3 AS (SELECT *, {_all('s9', 's10')} AS s11, 'SKIP' AS s12 FROM st2),
checks AS ({' UNION ALL '.join(f"SELECT element_id, {i} AS seq, '{r['id']}' AS rule_id, s{i} AS status, '{r['severity']}' AS severity FROM st3" for i, r in enumerate(r for lv in ('level_1', 'level_3', 'level_6', 'level_4') for r in BASIC[lv]))})"""
_CK = with_(*GROUPED[:5], _TIGHT, *GROUPED[5:], _GS, _OWN, *_FULL, _CHECKS)
_MISS = [
    "CASE WHEN price IS NULL THEN 'SKIP' WHEN price > 100000 AND closed THEN 'PASS' ELSE 'FAIL' END", "CASE WHEN price IS NULL THEN 'SKIP' WHEN closed OR price > 0 THEN 'PASS' ELSE 'FAIL' END", "'FAIL'",
    "CASE WHEN part = 0 THEN 'SKIP' WHEN 10 / part > 4 THEN 'PASS' ELSE 'FAIL' END", "CASE WHEN part = 0 THEN 'SKIP' WHEN 10 % part = 1 THEN 'PASS' ELSE 'FAIL' END", "CASE WHEN NOT closed THEN 'PASS' ELSE 'FAIL' END",
    "CASE WHEN part <> 0 THEN 'PASS' ELSE 'FAIL' END", "CASE WHEN abs(part - 2) < 1 THEN 'PASS' ELSE 'FAIL' END", "'SKIP'", "'PASS'", "'SKIP'",
]

QUERIES = {f.__name__: f for f in (wall_axis_pca, face_labels, category_summary, element_role, role_histogram, classification_confidence, crown_width, crown_slope, wall_thickness, front_inclination, wall_height, plumbness, triangle_slopes, surface_slopes, rule_checks, check_summary, rule_compliance, composite_rules, rule_missing_skips)}
SQL = {
    "wall_axis_pca": f"{with_(*GROUPED, _GS, _AXIS)} SELECT element_id, round(ax, 6) + 0 AS ax, round(ay, 6) + 0 AS ay FROM axis",
    "face_labels": f"{_TO(_LABEL)} SELECT element_id, group_id, category FROM lab",
    "category_summary": f"{_TO(_LABEL, _SUM)} SELECT element_id, {', '.join(f'{c}_count, round({c}_area, 6) AS {c}_area' for c in classify.CATEGORIES)} FROM catsum",
    "element_role": f"{_TO(_LABEL, _SUM, _BOX, _ROLE)} SELECT element_id, is_wall_like, element_role FROM roles",
    "role_histogram": f"{_TO(_LABEL, _SUM, _BOX, _ROLE)} SELECT element_role, count(*) AS n FROM roles GROUP BY 1",
    "classification_confidence": f"{_TO(_LABEL, _SUM, _BOX, _ROLE)} SELECT element_id, confidence FROM roles",
    "crown_width": _r3("crown_width_mm", "foundation_width_mm"), "crown_slope": _r3("crown_slope_percent"), "wall_thickness": _r3("min_wall_thickness_mm", "avg_wall_thickness_mm"),
    "front_inclination": _r3("front_inclination_deg", "front_inclination_ratio"), "wall_height": f"{_TO(_LABEL, _POINTS, _L3)} SELECT element_id, wall_height_m, wall_length_m, foundation_width_ratio FROM level3",
    "plumbness": f"{_TO(_LABEL)} SELECT element_id, round(sum(degrees(asin(least(abs(gz), 1))) * area) / sum(area), 3) AS front_plumbness_deg, max(degrees(asin(least(abs(gz), 1)))) < 0.5 AS is_plumb FROM lab WHERE category = 'front' GROUP BY 1",
    "triangle_slopes": f"{_TO(_SLOPE)} SELECT element_id, fid, round(slope_pct, 5) + 0 AS slope_pct, round(cross_pct, 5) + 0 AS cross_pct, round(long_pct, 5) + 0 AS long_pct FROM slo",
    "surface_slopes": f"{_TO(_LABEL, _SLOPE)} SELECT s.element_id, {', '.join(f'round(sum({c}_pct * s.area) / sum(s.area), 5) + 0 AS {c}_slope_avg_pct, round(max({c}_pct), 5) + 0 AS {c}_slope_max_pct' for c in ('cross', 'long'))} FROM slo s JOIN comp USING (element_id, fid) JOIN lab l ON l.element_id = s.element_id AND l.group_id = component WHERE category = 'crown' GROUP BY 1",
    "rule_checks": f"{_CK} SELECT * FROM checks",
    "check_summary": f"{_CK} SELECT element_id, count(*) AS total, count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'FAIL') AS failed, count(*) FILTER (WHERE status = 'SKIP') AS skipped, count(*) FILTER (WHERE status = 'FAIL' AND severity = 'ERROR') AS errors, count(*) FILTER (WHERE status = 'FAIL' AND severity = 'WARNING') AS warnings FROM checks GROUP BY 1",
    "rule_compliance": f"{_CK} SELECT rule_id, count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'FAIL') AS failed, count(*) FILTER (WHERE status = 'SKIP') AS skipped FROM checks GROUP BY 1",
    "composite_rules": f"""{_CK} SELECT element_id, 'L4-BODY' AS rule_id, s9 AS status, 'L1-CLOSED=' || s1 || ',L1-VOLUME=' || s0 AS parts FROM st3 UNION ALL SELECT element_id, 'L4-SHAPE', s10, 'L3-CROWN=' || s3 || ',L3-SLOPE=' || s5 || ',L3-THICK=' || s4 FROM st3
UNION ALL SELECT element_id, 'L4-ALL', s11, 'L4-BODY=' || s9 || ',L4-SHAPE=' || s10 FROM st3 UNION ALL SELECT element_id, 'L4-SITE', s12, 'L6-DEPTH=' || s8 FROM st3""",
    "rule_missing_skips": "WITH o AS (SELECT o_orderkey AS element_id, CASE WHEN o_totalprice < 50000 THEN NULL ELSE o_totalprice END AS price, (o_custkey % 3)::DOUBLE AS part, o_orderstatus = 'F' AS closed FROM orders) " + " UNION ALL ".join(f"SELECT element_id, 'R{i:02d}' AS rule_id, {c} AS status FROM o" for i, c in enumerate(_MISS)),
}
