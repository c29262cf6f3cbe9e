"""L5, L6, statistics, comparison and report queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import classify, measure, mesh, pairs, solid, stats, terrain
from ..operators.spread import evenly
from ..report import sinks
from ..rules.evaluate import BASIC, evaluate, summary
from ..sources import tables
from .sql_base import BOXES, NORMALS, TERRAIN, TRIS, VERTS, WALLS, with_
from .walls import _CK, _LABEL, _POINTS, _TO, _groups, classified, context


def _boxes(spark, d):
    return tables.boxes(tables.walls(spark, d))


def _box_triangles(boxes):
    """Boxes as walls without batter or fall, for their triangles."""
    w = boxes.selectExpr("element_id", "max_x - min_x AS l", "max_y - min_y AS t", "max_z - min_z AS h", "min_x AS x0", "min_y AS y0", "min_z AS z0", "0D AS dy", "0D AS dz")
    return mesh.normals(tables.triangles(w, deal=False))


def aabb_pairs(spark, d):
    return pairs.box_pairs(_boxes(spark, d), 1.0).select("a_id", "b_id")


def pair_gaps(spark, d):
    return pairs.box_pairs(_boxes(spark, d), 1.0).select("a_id", "b_id", "gap_x", "gap_y", "gap_z")


def nearby_pairs_grid(spark, d):
    return pairs.distance_xy(pairs.box_pairs(_boxes(spark, d), 5.0)).select("a_id", "b_id", "distance_xy_mm")


def aabb_overlap(spark, d):
    return pairs.overlap_volume(pairs.box_pairs(_boxes(spark, d), 0.0)).select("a_id", "b_id", "overlap_volume")


def overlap_check(spark, d):
    """Overlapping walls with the vertices and middles of sides that reach into the other."""
    w = tables.walls(spark, d)
    return pairs.penetration(pairs.box_pairs(_wall_boxes(spark, d), 0.0), tables.vertices(w), tables.triangles(w))


def _contact(spark, d):
    b = _boxes(spark, d)
    return pairs.contact(pairs.box_pairs(b, 1.0), _box_triangles(b))


def contact_classification(spark, d):
    return _contact(spark, d).select("a_id", "b_id", "pair_type", "upper_id", "lower_id")


def overhang(spark, d):
    return pairs.overhang(_contact(spark, d))


def dilatation_joints(spark, d):
    b = evenly(_boxes(spark, d), tables.walls(spark, d).select("element_id", "model_id"), "element_id")
    return pairs.dilatation_joints(b, "model_id")


def _wall_boxes(spark, d):
    return tables.wall_boxes(tables.walls(spark, d))


def element_distances(spark, d):
    return pairs.vertex_distances(pairs.box_pairs(_wall_boxes(spark, d), 5.0), tables.vertices(tables.walls(spark, d)))


def pair_distances(spark, d):
    """All four distances of neighbours."""
    return pairs.all_distances(pairs.box_pairs(_wall_boxes(spark, d), 5.0), tables.vertices(tables.walls(spark, d)))


def nearest_neighbor_distance(spark, d):
    return pairs.nearest(element_distances(spark, d))


def terrain_height(spark, d):
    p = tables.placed(tables.walls(spark, d)).selectExpr("element_id", "x0 + l / 2 AS x", "y0 + t / 2 AS y")
    return terrain.heights(p, tables.terrain(spark, d)).select("element_id", F.round("terrain_z", 9).alias("terrain_z"))


def crown_clearance(spark, d):
    p = tables.vertices(tables.walls(spark, d)).where("vid >= 4")
    c = terrain.crown_clearance(p, tables.terrain(spark, d))
    return c.select("element_id", *(F.round(n, 9).alias(n) for n in ("min_clearance", "max_clearance", "avg_clearance")), "n_points")


def foundation_embedment(spark, d):
    p = tables.placed(tables.walls(spark, d)).selectExpr("element_id", "x0 + l / 2 AS x", "y0 + t / 2 AS y", "z0 AS z")
    return terrain.heights(p, tables.terrain(spark, d)).where("terrain_z IS NOT NULL").select("element_id", F.round(F.col("terrain_z") - F.col("z"), 9).alias("foundation_embedment_m"))


def terrain_side(spark, d):
    g = _groups(classified(spark, d)).where("category IN ('front', 'back')")
    return terrain.side(g, tables.terrain(spark, d)).select("element_id", "group_id", "side")


def _line(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    i = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")).cast("int") - 1
    return n.select(F.col("n_regionkey").cast("bigint").alias("line_id"), i.alias("i"), F.expr("(n_nationkey % 5) * 80D").alias("lx"), F.expr("n_nationkey * n_nationkey * 0.25D").alias("ly"))


def alignment_context(spark, d):
    p = tables.placed(tables.walls(spark, d)).selectExpr("element_id", "x0 + l / 2 AS x", "y0 + t / 2 AS y")
    return terrain.nearest_vertex(p, _line(spark, d)).select("element_id", "line_id", "i", F.round("distance_m", 6).alias("distance_m"))


def curvature_profile(spark, d):
    return terrain.curvature(_line(spark, d)).select("line_id", "i", F.round("curvature", 9).alias("curvature"), F.round("radius", 5).alias("radius"))


def slice_tolerance(spark, d):
    return terrain.slice_tolerance(_line(spark, d)).select("line_id", F.round("tolerance", 6).alias("tolerance"))


_OCTAGON = [(-0.5, -1.0), (0.5, -1.0), (1.0, -0.5), (1.0, 0.5), (0.5, 1.0), (-0.5, 1.0), (-1.0, 0.5), (-1.0, -0.5)]


def _cloud(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").selectExpr("vec_id", "CAST(embedding[0] AS DOUBLE) AS x", "CAST(embedding[1] AS DOUBLE) AS y")


def point_in_polygon(spark, d):
    return terrain.in_polygon(_cloud(spark, d), _OCTAGON).select("vec_id", "inside", F.round("depth", 6).alias("depth"))


def clearance_check(spark, d):
    """Walls' vertices against the road profile about a line along x through each lane of 8 m."""
    p = tables.vertices(tables.walls(spark, d)).selectExpr("element_id", "y - floor(y / 8) * 8 - 4 AS x", "z AS y")
    c = terrain.in_polygon(p, terrain.road_clearance())
    return c.groupBy("element_id").agg(F.count_if("inside").alias("n_inside"), F.round(F.max("depth"), 6).alias("max_depth"))


#: A profile whose sides no vertex or midpoint of the derived walls touches.
_PATH, _PATH_Z = [(-0.30534, 0.0), (0.30534, 0.0), (0.30534, 3.30174), (-0.30534, 3.30174)], 0.07


def line_clearance(spark, d):
    """Walls against a path's profile drawn along their own centreline."""
    return measure.clearance(solid.with_centreline(classified(spark, d)), _PATH, reference_z=_PATH_Z).drop("violations")


def taper_profile(spark, d):
    t = measure.with_taper(classified(spark, d)).where("n_slices > 0")
    return t.select("element_id", "n_slices", *(F.round(n, 5).alias(n) for n in ("thickness_min_mm", "thickness_max_mm")))


def cross_section_extent(spark, d):
    """The section half way along each wall."""
    s = measure.sections(classified(spark, d))
    return s.select("element_id", "n", F.round("width", 6).alias("width"), F.round("height", 6).alias("height"), F.size("outline").cast("bigint").alias("n_outline"))


def anomaly_missing_faces(spark, d):
    """Stems that lack a crown, foundation, front or back; every ninth wall's crowns are struck out."""
    r = classify.describe(classified(spark, d)).where("element_role = 'wall_stem'").withColumn("crown_count", F.expr("IF(element_id % 9 = 0, 0, crown_count)"))
    need = F.explode(F.array(*(F.when(F.col(f"{c}_count") == 0, c) for c in ("crown", "foundation", "front", "back"))))
    return r.select("element_id", need.alias("missing")).where("missing IS NOT NULL")


def anomaly_aspect(spark, d):
    m = context(spark, d)
    return m.select("element_id", F.expr("bbox_dim_max_m / bbox_dim_min_m > 50").alias("slender"), F.expr("crown_width_mm < 0.5 * min_wall_thickness_mm").alias("narrow_crown"))


def anomaly_profile_steps(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return stats.profile_steps(e.selectExpr("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"]).select("user_id", "position", F.round("step", 6).alias("step"))


def normal_consistency(spark, d):
    """One triangle in five of every third wall turned over."""
    t = tables.triangles(tables.walls(spark, d))
    turn = "element_id % 3 = 0 AND fid % 2 = 0"
    t = t.withColumns({f"{c}{i}": F.expr(f"IF({turn}, {c}{3 - i}, {c}{i})") for c in "xyz" for i in (1, 2)})
    return stats.normal_consistency(t).select("element_id", "pos", "neg", "inconsistent")


def summary_stats(spark, d):
    s = stats.distribution(spark.read.parquet(f"{d}/lineitem.parquet"), "l_returnflag", "l_extendedprice")
    return s.select("l_returnflag", "n", "min_value", "max_value", *(F.round(c, 2).alias(c) for c in ("mean_value", "std_value")), F.round("median_value", 4).alias("median_value"))


def mad_outliers(spark, d):
    o = spark.read.parquet(f"{d}/events.parquet")
    return stats.mad_outliers(o, "event_type", "event_id").select("event_type", "event_id", F.round("z", 6).alias("z"))


def _models(spark, d):
    a = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey AS element_id", "concat(p_name, '-', p_partkey % 1500) AS name", "p_retailprice AS price", "p_size AS size")
    b = a.where("element_id % 17 <> 0").withColumns({"price": F.expr("IF(element_id % 13 = 0, price + 25, price)"), "size": F.expr("IF(element_id % 7 = 0, NULL, size)")})
    return a.where("element_id % 19 <> 0"), b


def model_compare(spark, d):
    return stats.compare(*_models(spark, d), "name", {"price": 10.0, "size": 0.0})[0].select("name", "property", "a_value", "b_value", "exceeds")


def model_unmatched(spark, d):
    return stats.compare(*_models(spark, d), "name", {"price": 10.0})[1]


def entity_scan(spark, d):
    """Types with their counts, wall length and a sample name, most common first."""
    w = tables.walls(spark, d)
    return w.groupBy("predefined_type").agg(F.count("*").alias("n"), F.count_if(F.col("l") > 6).alias("n_long"), F.min("name").alias("sample"))


def name_glob_filter(spark, d):
    """Names by a shell pattern."""
    import fnmatch

    return tables.walls(spark, d).where(F.coalesce("name", F.lit("")).rlike(fnmatch.translate("*[aeiou]? *t").replace("(?s:", "(?s)^(?:"))).select("element_id", "name")


def threshold_sweep(spark, d):
    return stats.sweep(tables.walls(spark, d), "t", 0.125, 0.75, 0.125)


def csv_sanitize(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").withColumn("cell", F.expr("concat(element_at(array('=', '+', '-', '@', '\t', 'x', ''), CAST(o_orderkey % 7 AS INT) + 1), o_orderpriority)"))
    return o.select("o_orderkey", sinks.sanitize_csv("cell").alias("cell"))


def pset_properties(spark, d):
    m = context(spark, d)
    p = sinks.pset(m.select("element_id", "mesh_is_watertight", "element_role"), evaluate(m, BASIC).where("seq < 3"))
    return p.select("element_id", "name", "value")


def report_json(spark, d):
    m = context(spark, d)
    return sinks.json_report(m, evaluate(m, BASIC))


def ci_summary(spark, d):
    return sinks.ci_lines(tables.walls(spark, d), summary(evaluate(context(spark, d), BASIC)))


_PAIRS = lambda r, src="boxes": f"""pr AS (SELECT a.element_id AS a_id, b.element_id AS b_id, {', '.join(f'a.{m}_{c} AS a_{m}_{c}, b.{m}_{c} AS b_{m}_{c}' for m in ('min', 'max') for c in 'xyz')}, {', '.join(f'greatest(0, greatest(a.min_{c}, b.min_{c}) - least(a.max_{c}, b.max_{c}))::DOUBLE AS gap_{c}' for c in 'xyz')}
  FROM {src} a JOIN {src} b ON a.element_id < b.element_id AND {' AND '.join(f'a.min_{c} - b.max_{c} <= {r} AND b.min_{c} - a.max_{c} <= {r}' for c in 'xyz')})"""  # noqa: E731
_B = lambda r: with_(WALLS, BOXES, _PAIRS(r))
_BT = TRIS.replace("FROM walls, faces", "FROM bw, faces").replace("JOIN verts ", "JOIN bverts ")
_CONTACT = f"""bw AS (SELECT element_id, max_x - min_x AS l, max_y - min_y AS t, max_z - min_z AS h, min_x AS x0, min_y AS y0, min_z AS z0 FROM boxes),
corners(vid, cx, cy, cz) AS (VALUES (0,0,0,0),(1,1,0,0),(2,1,1,0),(3,0,1,0),(4,0,0,1),(5,1,0,1),(6,1,1,1),(7,0,1,1)), bverts AS (SELECT element_id, vid, x0 + cx * l AS x, y0 + cy * t AS y, z0 + cz * h AS z FROM bw, corners),
{_BT}, {NORMALS}, fc AS (SELECT element_id, ux, uy, uz, area, (x0 + x1 + x2) / 3 AS mx, (y0 + y1 + y2) / 3 AS my, (z0 + z1 + z2) / 3 AS mz FROM norms),
sm AS (SELECT element_id, least(CASE WHEN l > 1e-6 THEN l END, CASE WHEN t > 1e-6 THEN t END, CASE WHEN h > 1e-6 THEN h END) AS s FROM bw),
nr AS (SELECT a_id, b_id, sum(least(a.area, b.area) * a.ux) AS nx, sum(least(a.area, b.area) * a.uy) AS ny, sum(least(a.area, b.area) * a.uz) AS nz FROM pr JOIN fc a ON a.element_id = a_id JOIN fc b ON b.element_id = b_id JOIN sm p ON p.element_id = a_id JOIN sm q ON q.element_id = b_id
  WHERE pow(a.mx - b.mx, 2) + pow(a.my - b.my, 2) + pow(a.mz - b.mz, 2) < pow(least(p.s, q.s) / 2, 2) GROUP BY ALL),
k0 AS (SELECT pr.*, nx, ny, nz, sqrt(nx * nx + ny * ny + nz * nz) AS n, (a_min_x + a_max_x) / 2 - (b_min_x + b_max_x) / 2 AS ex, (a_min_y + a_max_y) / 2 - (b_min_y + b_max_y) / 2 AS ey, (a_min_z + a_max_z) / 2 - (b_min_z + b_max_z) / 2 AS ez FROM pr LEFT JOIN nr USING (a_id, b_id)),
k1 AS (SELECT *, CASE WHEN n IS NOT NULL THEN CASE WHEN n < 1e-10 THEN 1 ELSE abs(nz) / n END WHEN sqrt(ex * ex + ey * ey + ez * ez) < 1e-10 THEN CASE WHEN greatest(0, least(a_max_z, b_max_z) - greatest(a_min_z, b_min_z)) > 0.5 * least(a_max_z - a_min_z, b_max_z - b_min_z) THEN 0 ELSE 1 END ELSE abs(ez) / sqrt(ex * ex + ey * ey + ez * ez) END AS kappa FROM k0),
ct AS (SELECT *, CASE WHEN kappa > sqrt(0.5) THEN 'stacked' ELSE 'side_by_side' END AS pair_type, CASE WHEN kappa > sqrt(0.5) THEN CASE WHEN ez > 0 THEN a_id ELSE b_id END END AS upper_id, CASE WHEN kappa > sqrt(0.5) THEN CASE WHEN ez > 0 THEN b_id ELSE a_id END END AS lower_id FROM k1)"""
_NEAR = f"""{with_(WALLS, VERTS, BOXES, "wb AS (SELECT * FROM boxes WHERE element_id >= 0)", _PAIRS(5, 'wb'))}, dist AS (SELECT a_id, b_id, round(sqrt(min(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))) * 1000, 1) AS min_distance_mm FROM pr JOIN verts a ON a.element_id = a_id JOIN verts b ON b.element_id = b_id GROUP BY ALL)"""
_HEIGHT = lambda pts, extra="": f"""pt AS ({pts}), tt AS (SELECT *, greatest(greatest(x0, x1, x2) - least(x0, x1, x2), greatest(y0, y1, y2) - least(y0, y1, y2)) AS sz, (y1 - y2) * (x0 - x2) + (x2 - x1) * (y0 - y2) AS det FROM terrain),
hit AS (SELECT pt.*, fid AS tf, ((y1 - y2) * (x - x2) + (x2 - x1) * (y - y2)) / det AS u, ((y2 - y0) * (x - x2) + (x0 - x2) * (y - y2)) / det AS w, t.z0 AS tz0, t.z1 AS tz1, t.z2 AS tz2, sz FROM pt JOIN tt t ON x BETWEEN least(x0, x1, x2) - 1 AND greatest(x0, x1, x2) + 1 AND y BETWEEN least(y0, y1, y2) - 1 AND greatest(y0, y1, y2) + 1),
hz AS (SELECT * EXCLUDE (tf, u, w, tz0, tz1, tz2, sz), arg_min(u * tz0 + w * tz1 + (1 - u - w) * tz2, tf) AS terrain_z FROM hit WHERE least(u, w, 1 - u - w) >= -1e-9 * sz GROUP BY ALL),
hh AS (SELECT pt.*, hz.terrain_z FROM pt LEFT JOIN hz USING (element_id, x, y{extra}))"""  # noqa: E731
_SIDE = f"""{_HEIGHT("SELECT element_id, group_id, s, px, py, pz, gx, gy, gz, px + s * 1.0 * gx / sqrt(gx * gx + gy * gy) AS x, py + s * 1.0 * gy / sqrt(gx * gx + gy * gy) AS y FROM lab, (VALUES (1), (-1), (0)) q(s) WHERE category IN ('front', 'back')", ', group_id, s, px, py, pz, gx, gy, gz')},
rs AS (SELECT element_id, group_id, px, py, pz, gx, gy, gz, max(CASE WHEN s = 1 THEN terrain_z END) - max(CASE WHEN s = -1 THEN terrain_z END) AS r, max(CASE WHEN s = 0 THEN terrain_z END) AS own FROM hh GROUP BY ALL),
mids AS (SELECT fid, (x0 + x1 + x2) / 3 AS tx, (y0 + y1 + y2) / 3 AS ty, (z0 + z1 + z2) / 3 AS tz FROM terrain),
far0 AS (SELECT element_id, group_id, gx * (tx - px) + gy * (ty - py) + gz * (tz - pz) AS ahead, row_number() OVER (PARTITION BY element_id, group_id ORDER BY pow(tx - px, 2) + pow(ty - py, 2) + pow(tz - pz, 2), fid) AS k, pow(tx - px, 2) + pow(ty - py, 2) + pow(tz - pz, 2) AS d FROM rs, mids WHERE own IS NULL AND NOT coalesce(abs(r) > 0.01, false)),
sided AS (SELECT element_id, group_id, CASE WHEN r > 0.01 THEN 'back' WHEN r < -0.01 THEN 'front' WHEN gz * (own - pz) > 0 THEN 'back' ELSE 'front' END AS side FROM rs WHERE own IS NOT NULL OR abs(r) > 0.01 UNION ALL SELECT element_id, group_id, CASE WHEN ahead > 0 THEN 'back' ELSE 'front' END FROM far0 WHERE k = 1 AND d <= 2500)"""
_LINE = "line AS (SELECT n_regionkey::BIGINT AS line_id, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS i, (n_nationkey % 5) * 80.0::DOUBLE AS lx, n_nationkey * n_nationkey * 0.25::DOUBLE AS ly FROM nation)"
_CURVE = """cv AS (SELECT *, lag(lx) OVER w AS ax, lag(ly) OVER w AS ay, lead(lx) OVER w AS bx, lead(ly) OVER w AS by_ FROM line WINDOW w AS (PARTITION BY line_id ORDER BY i)),
cs AS (SELECT *, sqrt(pow(lx - ax, 2) + pow(ly - ay, 2)) AS l1, sqrt(pow(bx - lx, 2) + pow(by_ - ly, 2)) AS l2 FROM cv),
ck AS (SELECT *, CASE WHEN ax IS NOT NULL AND bx IS NOT NULL THEN coalesce(acos(greatest(-1, least(1, ((lx - ax) * (bx - lx) + (ly - ay) * (by_ - ly)) / nullif(l1 * l2, 0)))) / nullif((l1 + l2) / 2, 0), 0) END AS k FROM cs),
cf AS (SELECT line_id, i, l1, coalesce(k, lead(k) OVER w, lag(k) OVER w, 0) AS curvature FROM ck WINDOW w AS (PARTITION BY line_id ORDER BY i))"""


def _polygon_sql(poly, src, keep):
    sides = list(zip(poly, poly[1:] + poly[:1], strict=True))
    v = ", ".join(f"({p}::DOUBLE, {q}::DOUBLE, {r}::DOUBLE, {s}::DOUBLE)" for (p, q), (r, s) in sides)
    return f"""pts AS ({src}), sides(p, q, r, s) AS (VALUES {v}),
far AS (SELECT *, greatest(0, least(1, ((x - p) * (r - p) + (y - q) * (s - q)) / nullif(pow(r - p, 2) + pow(s - q, 2), 0))) AS t FROM pts, sides),
pip AS (SELECT {keep}, sum(CASE WHEN ((y < q) <> (y < s)) AND x < (r - p) * (y - q) / coalesce(nullif(s - q, 0), 1) + p THEN 1 ELSE 0 END) % 2 = 1 AS inside, min(sqrt(pow(x - p - t * (r - p), 2) + pow(y - q - t * (s - q), 2))) AS near FROM far GROUP BY ALL)"""


QUERIES = {f.__name__: f for f in (aabb_pairs, pair_gaps, nearby_pairs_grid, aabb_overlap, overlap_check, contact_classification, overhang, dilatation_joints, element_distances, pair_distances, nearest_neighbor_distance, terrain_height, crown_clearance, foundation_embedment, terrain_side, alignment_context, curvature_profile, slice_tolerance, point_in_polygon, clearance_check, line_clearance, taper_profile, cross_section_extent, anomaly_missing_faces, anomaly_aspect, anomaly_profile_steps, normal_consistency, summary_stats, mad_outliers, model_compare, model_unmatched, entity_scan, name_glob_filter, threshold_sweep, csv_sanitize, pset_properties, report_json, ci_summary)}
_MODELS = "a0 AS (SELECT p_partkey AS element_id, p_name || '-' || (p_partkey % 1500) AS name, p_retailprice AS price, p_size AS size FROM part), b0 AS (SELECT element_id, name, CASE WHEN element_id % 13 = 0 THEN price + 25 ELSE price END AS price, CASE WHEN element_id % 7 = 0 THEN NULL ELSE size END AS size FROM a0 WHERE element_id % 17 <> 0), {x}a AS (SELECT name, arg_max(price, element_id) AS price, arg_max(coalesce(size, 0), element_id) AS size FROM a0 WHERE element_id % 19 <> 0 GROUP BY 1), b AS (SELECT name, arg_max(price, element_id) AS price, arg_max(coalesce(size, 0), element_id) AS size FROM b0 GROUP BY 1)".replace("{x}", "")
SQL = {
    "aabb_pairs": f"{_B(1)} SELECT a_id, b_id FROM pr",
    "pair_gaps": f"{_B(1)} SELECT a_id, b_id, gap_x, gap_y, gap_z FROM pr",
    "nearby_pairs_grid": f"{_B(5)} SELECT a_id, b_id, round(sqrt(gap_x * gap_x + gap_y * gap_y) * 1000, 1) AS distance_xy_mm FROM pr",
    "aabb_overlap": f"{_B(0)} SELECT a_id, b_id, {' * '.join(f'(least(a_max_{c}, b_max_{c}) - greatest(a_min_{c}, b_min_{c}))' for c in 'xyz')} AS overlap_volume FROM pr WHERE {' AND '.join(f'least(a_max_{c}, b_max_{c}) > greatest(a_min_{c}, b_min_{c})' for c in 'xyz')}",
    "overlap_check": f"""{with_(WALLS, VERTS, TRIS, BOXES, "wb AS (SELECT * FROM boxes WHERE element_id >= 0)", _PAIRS(0, 'wb'))}, ov AS (SELECT *, {' * '.join(f'(least(a_max_{c}, b_max_{c}) - greatest(a_min_{c}, b_min_{c}))' for c in 'xyz')} AS vol FROM pr WHERE {' AND '.join(f'least(a_max_{c}, b_max_{c}) > greatest(a_min_{c}, b_min_{c})' for c in 'xyz')}),
mids AS (SELECT element_id, unnest([(x0 + x1) / 2, (x1 + x2) / 2, (x0 + x2) / 2]) AS x, unnest([(y0 + y1) / 2, (y1 + y2) / 2, (y0 + y2) / 2]) AS y, unnest([(z0 + z1) / 2, (z1 + z2) / 2, (z0 + z2) / 2]) AS z FROM tris),
pen AS (SELECT a_id, b_id, vol, {', '.join(f"(SELECT count(*) FROM {t} p WHERE p.element_id = {p}_id AND {' AND '.join(f'p.{c} BETWEEN {q}_min_{c} AND {q}_max_{c}' for c in 'xyz')}) AS {n}" for t, p, q, n in (('verts', 'a', 'b', 'a_in_b'), ('verts', 'b', 'a', 'b_in_a'), ('mids', 'a', 'b', 'edges_in_b')))} FROM ov)
SELECT a_id, b_id, round(vol, 4) AS overlap_volume_m3, a_in_b, b_in_a, edges_in_b, a_in_b + b_in_a + edges_in_b AS n_penetrating, a_in_b + b_in_a + edges_in_b = 0 AS clear FROM pen""",
    "contact_classification": f"{with_(WALLS, BOXES, _PAIRS(1), _CONTACT)} SELECT a_id, b_id, pair_type, upper_id, lower_id FROM ct",
    "overhang": f"""{with_(WALLS, BOXES, _PAIRS(1), _CONTACT)}, oh AS (SELECT upper_id, lower_id, u.max_x - u.min_x AS sx, u.max_y - u.min_y AS sy, least(u.min_x - l.min_x, l.max_x - u.max_x, u.min_y - l.min_y, l.max_y - u.max_y) AS m, u.min_z - l.max_z AS g FROM ct JOIN boxes u ON u.element_id = upper_id JOIN boxes l ON l.element_id = lower_id)
SELECT upper_id, lower_id, m >= -greatest(sx, sy) * 1e-6 AS extends, round(greatest(m, 0) * 1000, 1) AS overhang_mm, round(g * 1000, 1) AS vertical_gap_mm FROM oh""",
    "dilatation_joints": f"""{with_(WALLS, BOXES)}, bb AS (SELECT model_id, b.*, (min_x + max_x) / 2 AS mx, (min_y + max_y) / 2 AS my FROM boxes b JOIN walls USING (element_id)),
bp AS (SELECT *, CASE WHEN max(max_x) OVER w - min(min_x) OVER w >= max(max_y) OVER w - min(min_y) OVER w THEN mx ELSE my END AS pos FROM bb WINDOW w AS (PARTITION BY model_id)),
bl AS (SELECT model_id, element_id AS a_id, lead(element_id) OVER o AS b_id, lead(pos) OVER o - pos AS spacing_m FROM bp WINDOW o AS (PARTITION BY model_id ORDER BY pos, element_id)) SELECT *, spacing_m > 15 AS exceeds FROM bl WHERE b_id IS NOT NULL""",
    "element_distances": f"{_NEAR} SELECT * FROM dist",
    "pair_distances": f"""{_NEAR}, mv AS (SELECT element_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM verts GROUP BY 1)
SELECT a_id, b_id, min_distance_mm, round(sqrt(gap_x * gap_x + gap_y * gap_y) * 1000, 1) AS horizontal_mm, round(gap_z * 1000, 1) AS vertical_mm, round(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2)) * 1000, 1) AS centroid_mm
FROM dist JOIN pr USING (a_id, b_id) JOIN mv p ON p.element_id = a_id JOIN mv q ON q.element_id = b_id""",
    "nearest_neighbor_distance": f"{_NEAR} SELECT element_id, min(min_distance_mm) AS min_distance_to_nearest_mm FROM (SELECT a_id AS element_id, min_distance_mm FROM dist UNION ALL SELECT b_id, min_distance_mm FROM dist) GROUP BY 1",
    "terrain_height": f"{with_(WALLS, TERRAIN, _HEIGHT('SELECT element_id, x0 + l / 2 AS x, y0 + t / 2 AS y FROM walls'))} SELECT element_id, round(terrain_z, 9) AS terrain_z FROM hh",
    "crown_clearance": f"{with_(WALLS, VERTS, TERRAIN, _HEIGHT('SELECT element_id, vid, x, y, z FROM verts WHERE vid >= 4', ', vid, z'))} SELECT element_id, round(min(z - terrain_z), 9) AS min_clearance, round(max(z - terrain_z), 9) AS max_clearance, round(avg(z - terrain_z), 9) AS avg_clearance, count(terrain_z) AS n_points FROM hh GROUP BY 1",
    "foundation_embedment": f"{with_(WALLS, TERRAIN, _HEIGHT('SELECT element_id, x0 + l / 2 AS x, y0 + t / 2 AS y, z0 AS z FROM walls', ', z'))} SELECT element_id, round(terrain_z - z, 9) AS foundation_embedment_m FROM hh WHERE terrain_z IS NOT NULL",
    "terrain_side": f"{_TO(_LABEL, TERRAIN, _SIDE)} SELECT element_id, group_id, side FROM sided",
    "alignment_context": f"{with_(WALLS, _LINE)}, dd AS (SELECT element_id, line_id, i, pow(x0 + l / 2 - lx, 2) + pow(y0 + t / 2 - ly, 2) AS d FROM walls, line), rk AS (SELECT *, row_number() OVER (PARTITION BY element_id ORDER BY d, line_id, i) AS r FROM dd) SELECT element_id, line_id, i, round(sqrt(d), 6) AS distance_m FROM rk WHERE r = 1",
    "curvature_profile": f"{with_(_LINE, _CURVE)} SELECT line_id, i, round(curvature, 9) AS curvature, round(CASE WHEN curvature > 1e-10 THEN 1 / curvature ELSE 'Infinity'::DOUBLE END, 5) AS radius FROM cf",
    "slice_tolerance": f"{with_(_LINE, _CURVE)} SELECT line_id, round(coalesce(median(l1) * 0.6, 0.5), 6) AS tolerance FROM cf GROUP BY 1",
    "point_in_polygon": f"{with_(_polygon_sql(_OCTAGON, 'SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings', 'vec_id'))} SELECT vec_id, inside, round(CASE WHEN inside THEN near ELSE 0 END, 6) AS depth FROM pip",
    "clearance_check": f"{with_(WALLS, VERTS, _polygon_sql(terrain.road_clearance(), 'SELECT element_id, vid, y - floor(y / 8) * 8 - 4 AS x, z AS y FROM verts', 'element_id, vid'))} SELECT element_id, count(*) FILTER (WHERE inside) AS n_inside, round(max(CASE WHEN inside THEN near ELSE 0 END), 6) AS max_depth FROM pip GROUP BY 1",
    "line_clearance": f"""{with_(WALLS, VERTS)}, se AS (SELECT element_id, vid, y - (y0 + t / 2 + dy / 4) AS x, z - {_PATH_Z} AS y FROM verts JOIN walls USING (element_id) WHERE vid IN (0, 3, 4, 7)),
sp AS (SELECT element_id, vid AS a, -1 AS b, x, y FROM se UNION ALL SELECT p.element_id, p.vid, q.vid, (p.x + q.x) / 2, (p.y + q.y) / 2 FROM se p JOIN se q ON p.element_id = q.element_id AND p.vid < q.vid), {_polygon_sql(_PATH, 'SELECT element_id, a, b, x, y FROM sp', 'element_id, a, b')}
SELECT element_id, 20 * count(*) FILTER (WHERE inside) AS n_violations, 20::BIGINT AS n_slices_checked, round(max(CASE WHEN inside THEN near ELSE 0 END) * 1000, 1) AS max_penetration_mm, count(*) FILTER (WHERE inside) = 0 AS clear FROM pip GROUP BY 1""",
    "taper_profile": f"""{_TO(_LABEL, _POINTS)}, sp AS (SELECT element_id, min(z) AS lo, max(z) - min(z) AS h FROM pts WHERE category IN ('front', 'back') GROUP BY 1), sl AS (SELECT element_id, lo, h, i, lo + h * (0.05 + 0.9 * i / 9) AS height FROM sp, range(10) r(i)),
th AS (SELECT element_id, i, abs(median(across) FILTER (WHERE category = 'front') - median(across) FILTER (WHERE category = 'back')) * 1000 AS th FROM sl JOIN pts USING (element_id) WHERE category IN ('front', 'back') AND abs(z - height) <= h / 10 * 0.6 GROUP BY ALL)
SELECT element_id, count(*) AS n_slices, round(min(th), 5) AS thickness_min_mm, round(max(th), 5) AS thickness_max_mm FROM th WHERE th IS NOT NULL GROUP BY 1""",
    "cross_section_extent": f"{with_(WALLS, VERTS)}, vp AS (SELECT element_id, y, z, dy, t FROM verts JOIN walls USING (element_id)) SELECT element_id, count(*) AS n, round(max(y) - min(y), 6) AS width, round(max(z) - min(z), 6) AS height, 4::BIGINT AS n_outline FROM vp GROUP BY 1",
    "anomaly_missing_faces": f"{_CK}, mf AS (SELECT element_id, unnest(['crown', 'foundation', 'front', 'back']) AS missing, unnest([CASE WHEN element_id % 9 = 0 THEN 0 ELSE crown_count END, foundation_count, front_count, back_count]) AS n FROM roles WHERE element_role = 'wall_stem') SELECT element_id, missing FROM mf WHERE n = 0",
    "anomaly_aspect": f"{_CK} SELECT element_id, greatest(bx, by_, bz) / least(bx, by_, bz) > 50 AS slender, crown_width_mm < 0.5 * min_wall_thickness_mm AS narrow_crown FROM ctx",
    "anomaly_profile_steps": """WITH p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events), q AS (SELECT * FROM p WHERE n >= 5 AND i >= floor(n * 0.15) AND i < n - floor(n * 0.15)),
d AS (SELECT user_id, i, value - lag(value) OVER (PARTITION BY user_id ORDER BY i) AS step FROM q), e AS (SELECT * FROM d WHERE step IS NOT NULL), m AS (SELECT user_id, median(step) AS m FROM e GROUP BY 1), o AS (SELECT e.*, abs(step - m) AS dev FROM e JOIN m USING (user_id)), s AS (SELECT user_id, median(dev) / 0.6745 AS s FROM o GROUP BY 1)
SELECT user_id, i AS position, round(step, 6) AS step FROM o JOIN s USING (user_id) WHERE s > 1e-10 AND dev > 3 * s AND abs(step) > 50""",
    "normal_consistency": f"""{with_(WALLS, VERTS, TRIS)}, tt AS (SELECT element_id, x0, y0, z0, {', '.join(f'CASE WHEN element_id % 3 = 0 AND fid % 2 = 0 THEN {c}{3 - i} ELSE {c}{i} END AS {c}{i}' for c in 'xyz' for i in (1, 2))} FROM tris),
mm AS (SELECT element_id, {', '.join(f'avg(({c}0 + {c}1 + {c}2) / 3) AS m{c}' for c in 'xyz')}, count(*) AS n FROM tt GROUP BY 1),
vv AS (SELECT element_id, n, (x0 - mx) * ((y1 - my) * (z2 - mz) - (z1 - mz) * (y2 - my)) + (y0 - my) * ((z1 - mz) * (x2 - mx) - (x1 - mx) * (z2 - mz)) + (z0 - mz) * ((x1 - mx) * (y2 - my) - (y1 - my) * (x2 - mx)) AS v FROM tt JOIN mm USING (element_id))
SELECT element_id, count(*) FILTER (WHERE v > 0) AS pos, count(*) FILTER (WHERE v < 0) AS neg, max(n) >= 4 AND least(count(*) FILTER (WHERE v > 0), count(*) FILTER (WHERE v < 0)) / max(n) > 0.3 AS inconsistent FROM vv GROUP BY 1""",
    "summary_stats": "SELECT l_returnflag, count(*) AS n, min(l_extendedprice) AS min_value, max(l_extendedprice) AS max_value, round(avg(l_extendedprice), 2) AS mean_value, round(median(l_extendedprice), 4) AS median_value, round(stddev_pop(l_extendedprice), 2) AS std_value FROM lineitem WHERE l_extendedprice <> 0 GROUP BY 1",
    "mad_outliers": "WITH v AS (SELECT * FROM events WHERE value <> 0), m AS (SELECT event_type, median(value) AS m FROM v GROUP BY 1 HAVING count(*) >= 3), o AS (SELECT event_type, event_id, value, m, abs(value - m) AS d FROM v JOIN m USING (event_type)), s AS (SELECT event_type, median(d) AS mad FROM o GROUP BY 1 HAVING median(d) >= 1e-10) SELECT event_type, event_id, round(0.6745 * (value - m) / mad, 6) AS z FROM o JOIN s USING (event_type) WHERE abs(0.6745 * (value - m) / mad) > 3",
    "model_compare": f"WITH {_MODELS} SELECT name, property, av::DOUBLE AS a_value, bv::DOUBLE AS b_value, abs(av - bv) > tol AS exceeds FROM (SELECT name, 'price' AS property, a.price AS av, b.price AS bv, 10 AS tol FROM a JOIN b USING (name) UNION ALL SELECT name, 'size', a.size, b.size, 0 FROM a JOIN b USING (name))",
    "model_unmatched": f"WITH {_MODELS} SELECT name, 'a' AS side FROM a WHERE name NOT IN (SELECT name FROM b) UNION ALL SELECT name, 'b' FROM b WHERE name NOT IN (SELECT name FROM a)",
    "entity_scan": f"{with_(WALLS)} SELECT predefined_type, count(*) AS n, count(*) FILTER (WHERE l > 6) AS n_long, min(name) AS sample FROM walls GROUP BY 1",
    "name_glob_filter": "SELECT p_partkey AS element_id, p_name AS name FROM part WHERE p_name GLOB '*[aeiou]? *t'",
    "threshold_sweep": f"{with_(WALLS)} SELECT 0.125::DOUBLE + i * 0.125::DOUBLE AS threshold, (SELECT count(*) FROM walls WHERE t >= 0.125 + i * 0.125) AS passing FROM range(6) r(i)",
    "csv_sanitize": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 5 THEN '''' ELSE '' END || ['=', '+', '-', '@', chr(9), 'x', ''][(o_orderkey % 7 + 1)::INT] || o_orderpriority AS cell FROM orders",
    "pset_properties": f"{_CK} SELECT element_id, 'mesh_is_watertight' AS name, is_watertight::VARCHAR AS value FROM ctx UNION ALL SELECT element_id, 'element_role', element_role FROM ctx UNION ALL SELECT element_id, 'Rule_' || replace(rule_id, '-', '_'), status FROM checks WHERE seq < 3",
    "ci_summary": f"{_CK}, su AS (SELECT element_id, count(*) FILTER (WHERE status = 'PASS') AS p, count(*) FILTER (WHERE status = 'FAIL') AS f, count(*) FILTER (WHERE status = 'SKIP') AS s, count(*) FILTER (WHERE status = 'FAIL' AND severity = 'ERROR') AS e FROM checks GROUP BY 1) SELECT CASE WHEN e > 0 THEN 'FAIL' ELSE 'PASS' END || chr(9) || '#' || element_id || chr(9) || name || chr(9) || 'L4(' || p || 'P/' || f || 'F/' || s || 'S)' AS line FROM su JOIN walls USING (element_id)",
}
