"""DuckDB common table expressions of the derived geometry, for the oracle queries."""

from ..sources.tables import CORNERS, FACES

_values = lambda rows: ", ".join(f"({', '.join(map(str, r))})" for r in rows)

WALLS = """walls AS (SELECT p_partkey AS element_id, p_name AS name, p_brand AS model_id, p_type AS predefined_type,
  4 + (p_size % 10) * 0.5::DOUBLE AS l, 0.25::DOUBLE + (p_partkey % 4) * 0.125::DOUBLE AS t, 2 + (p_partkey % 7) * 0.5::DOUBLE AS h,
  (p_partkey % 40) * 8.0::DOUBLE AS x0, ((p_partkey // 40) * 2)::DOUBLE AS y0, (p_partkey % 3)::DOUBLE AS z0,
  (p_size % 3) * 0.0625::DOUBLE AS dy, (p_partkey % 3) * 0.015625::DOUBLE AS dz FROM part)"""
VERTS = f"""corners(vid, cx, cy, cz) AS (VALUES {_values([(i, *c) for i, c in enumerate(CORNERS)])}),
verts AS (SELECT element_id, vid, x0 + cx * l AS x, y0 + cy * t + cz * (1 - cy) * dy AS y, z0 + cz * h + cz * cy * dz AS z FROM walls, corners)"""
TRIS = f"""faces(fid, fa, fb, fc) AS (VALUES {_values([(i, *f) for i, f in enumerate(FACES)])}),
ftris AS (SELECT element_id, fid, fa AS a, CASE WHEN element_id % 11 = 3 THEN fc ELSE fb END AS b, CASE WHEN element_id % 11 = 3 THEN fb ELSE fc END AS c
  FROM walls, faces WHERE NOT (element_id % 13 = 5 AND fid = 11)),
tris AS (SELECT f.*, p.x AS x0, p.y AS y0, p.z AS z0, q.x AS x1, q.y AS y1, q.z AS z1, r.x AS x2, r.y AS y2, r.z AS z2 FROM ftris f
  JOIN verts p ON p.element_id = f.element_id AND p.vid = f.a JOIN verts q ON q.element_id = f.element_id AND q.vid = f.b JOIN verts r ON r.element_id = f.element_id AND r.vid = f.c)"""
NORMALS = """norms AS (SELECT *, nx / coalesce(nullif(len, 0), 1) AS ux, ny / coalesce(nullif(len, 0), 1) AS uy, nz / coalesce(nullif(len, 0), 1) AS uz, len / 2 AS area FROM (
  SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS len FROM (SELECT *, (y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0) AS nx,
  (z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0) AS ny, (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) AS nz FROM tris)))"""
BOXES = """boxes AS (SELECT element_id, x0 AS min_x, y0 AS min_y, z0 AS min_z, x0 + l AS max_x, y0 + t AS max_y, z0 + h + dz AS max_z FROM walls
  UNION ALL SELECT -1 - element_id, x0, y0 - 0.25, z0 - 0.5 - g, x0 + l, y0 + t + 0.25, z0 - g FROM (SELECT *, CASE WHEN element_id % 2 = 0 THEN 0.125 ELSE 0.0 END::DOUBLE AS g FROM walls) WHERE element_id % 5 = 0)"""
TERRAIN = """grid AS (SELECT n_nationkey AS k, (n_nationkey % 5) * 80.0::DOUBLE AS x, (n_nationkey // 5) * 30.0::DOUBLE AS y, n_regionkey * 0.5::DOUBLE AS z FROM nation),
cells AS (SELECT ((k // 5) * 4 + k % 5) * 2 AS fid, k AS a, k + 1 AS b, k + 6 AS c FROM grid WHERE k % 5 < 4 AND k < 20
  UNION ALL SELECT ((k // 5) * 4 + k % 5) * 2 + 1, k, k + 6, k + 5 FROM grid WHERE k % 5 < 4 AND k < 20),
terrain AS (SELECT fid, p.x AS x0, p.y AS y0, p.z AS z0, q.x AS x1, q.y AS y1, q.z AS z1, r.x AS x2, r.y AS y2, r.z AS z2 FROM cells
  JOIN grid p ON p.k = a JOIN grid q ON q.k = b JOIN grid r ON r.k = c)"""


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"
