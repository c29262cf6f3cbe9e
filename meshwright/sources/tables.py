"""Meshes, terrain and models derived from the warehouse tables, by projection and explode alone (no join).

Every coordinate is a multiple of 1/64, so sums and products of a few of them are exact in doubles whatever their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.spread import dealt, evenly

#: Corners of a box by vertex number, as factors of length, thickness and height (fixed values).
CORNERS = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
#: Triangles of a box by face number: bottom, top, front, back, left, right (fixed values).
FACES = [(0, 2, 1), (0, 3, 2), (4, 5, 6), (4, 6, 7), (0, 1, 5), (0, 5, 4), (2, 3, 7), (2, 7, 6), (0, 4, 7), (0, 7, 3), (1, 2, 6), (1, 6, 5)]


def walls(spark, sf_dir: str) -> DataFrame:
    """A wall a part: size, place, front batter ``dy`` and crown fall ``dz``."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        "p_partkey AS element_id", "p_name AS name", "p_brand AS model_id", "p_type AS predefined_type",
        "4 + (p_size % 10) * 0.5D AS l", "0.25D + (p_partkey % 4) * 0.125D AS t", "2 + (p_partkey % 7) * 0.5D AS h",
        "(p_partkey % 40) * 8.0D AS x0", "CAST(floor(p_partkey / 40) * 2 AS DOUBLE) AS y0", "CAST(p_partkey % 3 AS DOUBLE) AS z0",
        "(p_size % 3) * 0.0625D AS dy", "(p_partkey % 3) * 0.015625D AS dz",
    )


def _points() -> str:
    rows = []
    for cx, cy, cz in CORNERS:
        y = "y0" + (" + t" if cy else "") + (" + dy" if cz and not cy else "")
        z = "z0" + (" + h" if cz else "") + (" + dz" if cz and cy else "")
        rows.append(f"named_struct('x', x0{' + l' if cx else ''}, 'y', {y}, 'z', {z})")
    return f"array({', '.join(rows)})"


def vertices(walls: DataFrame) -> DataFrame:
    """(element_id, vid, x, y, z), over the tasks of ``triangles``."""
    return placed(walls).selectExpr("element_id", f"posexplode({_points()}) AS (vid, p)").selectExpr("element_id", "vid", "p.x", "p.y", "p.z")


def placed(walls: DataFrame) -> DataFrame:
    """Walls dealt to tasks by their triangles, for what makes many rows of each: a few megabytes of sizes are one task else."""
    return dealt(walls, "element_id", len(FACES))


def triangles(walls: DataFrame, deal: bool = True) -> DataFrame:
    """(element_id, fid, a, b, c, x0..z2): some walls are wound inside out, some lack a face. ``deal``: over tasks by their number."""
    faces = "array(" + ", ".join(f"named_struct('a', {a}, 'b', {b}, 'c', {c})" for a, b, c in FACES) + ")"
    rows = (placed(walls) if deal else walls).selectExpr("element_id", f"{_points()} AS p", f"posexplode({faces}) AS (fid, f)")
    rows = rows.where("NOT (element_id % 13 = 5 AND fid = 11)")
    rows = rows.selectExpr("element_id", "fid", "p", "f.a", "IF(element_id % 11 = 3, f.c, f.b) AS b", "IF(element_id % 11 = 3, f.b, f.c) AS c")
    return rows.selectExpr("element_id", "fid", "a", "b", "c", *(f"p[{v}].{k} AS {k}{i}" for i, v in enumerate("abc") for k in "xyz"))


def meshes(walls: DataFrame) -> DataFrame:
    """(element_id, t, v): the walls of ``vertices`` and ``triangles`` as one row an element, dealt to tasks by their triangles."""
    faces = "array(" + ", ".join(f"named_struct('fid', {i}, 'a', {a}, 'b', {b}, 'c', {c})" for i, (a, b, c) in enumerate(FACES)) + ")"
    rows = placed(walls).selectExpr("element_id", f"{_points()} AS p", f"filter({faces}, f -> NOT (element_id % 13 = 5 AND f.fid = 11)) AS f")
    turned = "transform(f, f -> named_struct('fid', f.fid, 'a', f.a, 'b', IF(element_id % 11 = 3, f.c, f.b), 'c', IF(element_id % 11 = 3, f.b, f.c)))"
    corner = ", ".join(f"'{k}{i}', p[f.{v}].{k}" for i, v in enumerate("abc") for k in "xyz")
    rows = rows.selectExpr("element_id", f"transform({turned}, f -> named_struct('fid', f.fid, 'a', f.a, 'b', f.b, 'c', f.c, {corner})) AS t", "transform(p, (q, i) -> named_struct('vid', i, 'x', q.x, 'y', q.y, 'z', q.z)) AS v")
    return rows


def soup(vertices: DataFrame, triangles: DataFrame, keys: tuple[str, ...] = ("element_id",)) -> DataFrame:
    """Triangles (keys, fid, a, b, c) with the coordinates of their corners, from a vertex table, in one join."""
    corner = triangles.select(*keys, "fid", F.posexplode(F.array("a", "b", "c")).alias("k", "vid"))
    met = evenly(corner, vertices.select(*keys, "vid", "x", "y", "z"), [*keys, "vid"])
    sums = [F.max(F.when(F.col("k") == i, F.col(v))).alias(f"{v}{i}" if v != "vid" else "abc"[i]) for i in range(3) for v in ("vid", "x", "y", "z")]
    return met.groupBy(*keys, "fid").agg(*sums)


def terrain(spark, sf_dir: str) -> DataFrame:
    """(fid, x0..z2): the 25 nations are a grid of 5 by 5 points, two triangles a cell."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("n_nationkey AS k", "(n_nationkey % 5) * 80.0D AS x", "floor(n_nationkey / 5) * 30.0D AS y", "n_regionkey * 0.5D AS z")
    cells = n.where("k % 5 < 4 AND k < 20").selectExpr("k", "posexplode(array(named_struct('a', k, 'b', k + 1, 'c', k + 6), named_struct('a', k, 'b', k + 6, 'c', k + 5))) AS (half, f)")
    cells = cells.selectExpr("CAST((floor(k / 5) * 4 + k % 5) * 2 + half AS INT) AS fid", "f.a", "f.b", "f.c")
    points = n.selectExpr("k AS vid", "x", "y", "z", "0 AS site")
    return soup(points, cells.withColumn("site", F.lit(0)), ("site",)).selectExpr("fid", *(f"{k}{i}" for i in range(3) for k in "xyz"))


def _own_boxes(walls: DataFrame) -> DataFrame:
    return walls.selectExpr("element_id", "x0 AS min_x", "y0 AS min_y", "z0 AS min_z", "x0 + l AS max_x", "y0 + t AS max_y", "z0 + h + dz AS max_z")


def wall_boxes(walls: DataFrame) -> DataFrame:
    return _own_boxes(placed(walls))


def boxes(walls: DataFrame) -> DataFrame:
    """Bounding boxes of walls and of foundation slabs: every fifth part has one, of id -1 - id, some an eighth lower."""
    gap = "IF(element_id % 2 = 0, 0.125D, 0.0D)"
    walls = placed(walls)
    slab = walls.where("element_id % 5 = 0").selectExpr(
        "-1 - element_id AS element_id", "x0 AS min_x", "y0 - 0.25D AS min_y", f"z0 - 0.5D - {gap} AS min_z", "x0 + l AS max_x", "y0 + t + 0.25D AS max_y", f"z0 - {gap} AS max_z"
    )
    return _own_boxes(walls).union(slab)


def prisms(walls: DataFrame, outline: list[tuple[str, str]], caps: list[tuple[int, int, int]]) -> DataFrame:
    """(element_id, t, v): outlines (y, z), counter-clockwise, drawn out along x from x0 by l; ``caps``: the outline's triangles."""
    n = len(outline)
    points = [f"named_struct('x', x0{' + l' if far else ''}, 'y', y0 + ({y}), 'z', z0 + ({z}))" for far in (0, 1) for y, z in outline]
    faces = [f for i in range(n) for f in ((i, (i + 1) % n, n + (i + 1) % n), (i, n + (i + 1) % n, n + i))] + [(c, b, a) for a, b, c in caps] + [(n + a, n + b, n + c) for a, b, c in caps]
    listed = ", ".join(f"named_struct('fid', {i}, 'a', {a}, 'b', {b}, 'c', {c})" for i, (a, b, c) in enumerate(faces))
    corner = ", ".join(f"'{k}{i}', p[f.{v}].{k}" for i, v in enumerate("abc") for k in "xyz")
    rows = dealt(walls, "element_id", len(faces)).selectExpr("element_id", f"array({', '.join(points)}) AS p", f"array({listed}) AS f")
    return rows.selectExpr("element_id", f"transform(f, f -> named_struct('fid', f.fid, 'a', f.a, 'b', f.b, 'c', f.c, {corner})) AS t", "transform(p, (q, i) -> named_struct('vid', i, 'x', q.x, 'y', q.y, 'z', q.z)) AS v")


def stepped(walls: DataFrame) -> DataFrame:
    """Walls with a step of half a metre at half their height, behind the stem."""
    return prisms(walls, [("0D", "0D"), ("t + 0.5D", "0D"), ("t + 0.5D", "h / 2"), ("t", "h / 2"), ("t", "h"), ("0D", "h")], [(0, 1, 2), (0, 2, 3), (0, 3, 4), (0, 4, 5)])


def folded(walls: DataFrame) -> DataFrame:
    """Walls half a metre thicker, whose front leans back above half their height."""
    return prisms(walls, [("0D", "0D"), ("t + 0.5D", "0D"), ("t + 0.5D", "h"), ("h / 16", "h"), ("0D", "h / 2")], [(0, 1, 2), (0, 2, 4), (2, 3, 4)])


def bent(walls: DataFrame, segments: int = 24, turn: float = 90.0) -> DataFrame:
    """(element_id, t, v): walls along an arc of radius 2 l, drawn in equal segments."""
    side = f"transform(sequence(0, {segments}), i -> radians({turn}D) * i / {segments})"
    place = lambda r, z: f"named_struct('x', x0 + ({r}) * cos(a), 'y', y0 + ({r}) * sin(a), 'z', z0 + {z})"
    points = f"flatten(transform({side}, a -> array({place('2 * l - t / 2', '0D')}, {place('2 * l + t / 2', '0D')}, {place('2 * l - t / 2', 'h')}, {place('2 * l + t / 2', 'h')})))"
    quads = [(0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
    part = ", ".join(f"named_struct('a', 4 * i + {p}, 'b', 4 * i + {q}, 'c', 4 * i + {r})" for a, b, c, d in quads for p, q, r in ((a, b, c), (a, c, d)))
    ends = ", ".join(f"named_struct('a', {a}, 'b', {b}, 'c', {c})" for a, b, c in [(0, 1, 3), (0, 3, 2), *((4 * segments + x, 4 * segments + y, 4 * segments + z) for x, y, z in ((0, 2, 3), (0, 3, 1)))])
    corner = ", ".join(f"'{k}{i}', p[f.{v}].{k}" for i, v in enumerate("abc") for k in "xyz")
    rows = dealt(walls, "element_id", 8 * segments + 4).selectExpr("element_id", f"{points} AS p", f"concat(flatten(transform(sequence(0, {segments - 1}), i -> array({part}))), array({ends})) AS f")
    return rows.selectExpr("element_id", f"transform(f, (f, i) -> named_struct('fid', i, 'a', f.a, 'b', f.b, 'c', f.c, {corner})) AS t", "transform(p, (q, i) -> named_struct('vid', i, 'x', q.x, 'y', q.y, 'z', q.z)) AS v")
