"""Measurements of a mesh as SQL functions: ``register(spark)``, then ``SELECT mesh_volume(t, v) FROM meshes``.

``t``: an array of triangles (fid, a, b, c, x0 .. z2), ``v``: of vertices (vid, x, y, z), as ``solid.rows`` makes them. The bodies are
the expressions of ``operators``, so they are planned as if written out. Null meshes give null.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators import solid
from ..operators import text as F

T = "t ARRAY<STRUCT<fid BIGINT, a BIGINT, b BIGINT, c BIGINT, " + ", ".join(f"{c} DOUBLE" for c in solid.CORNER) + ">>"
V = "v ARRAY<STRUCT<vid BIGINT, x DOUBLE, y DOUBLE, z DOUBLE>>"


def _area(t: F.Sql) -> F.Sql:
    return solid.total(t, lambda x: solid._faced(x, F.lit(False))["area"])


def functions() -> dict[str, tuple[str, str, F.Sql]]:
    """By name the parameters, the type and the body."""
    t, v = F.col("t"), F.col("v")
    shared = F.size(F.filter(solid.edges(t), lambda r: F.size(r) != 2))
    size = lambda c: solid.highest(v, lambda p: p[c]) - solid.lowest(v, lambda p: p[c])
    return {
        "mesh_signed_volume": (f"{T}, {V}", "DOUBLE", solid._signed(t, v)),
        "mesh_volume": (f"{T}, {V}", "DOUBLE", F.abs(solid._signed(t, v))),
        "mesh_area": (T, "DOUBLE", _area(t)),
        "mesh_num_edges": (T, "BIGINT", F.size(solid.edges(t)).cast("bigint")),
        "mesh_is_watertight": (T, "BOOLEAN", shared == 0),
        **{f"mesh_size_{c}": (V, "DOUBLE", size(c)) for c in "xyz"},
    }


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session; gives their names."""
    made = functions()
    for name, (takes, gives, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")
    return list(made)
