"""Measurements as SQL functions against the operators' columns."""

import pytest

from meshwright import functions
from meshwright.operators import solid
from meshwright.sources import tables


def test_sql_functions_equal_the_operators(spark):
    names = functions.register(spark)
    meshes = tables.meshes(tables.walls(spark, "/root/testdata/sf0.001"))
    meshes.createOrReplaceTempView("some_meshes")
    got = {r["element_id"]: r for r in spark.sql("SELECT element_id, mesh_signed_volume(t, v) AS s, mesh_volume(t, v) AS vol, mesh_area(t) AS area, mesh_num_edges(t) AS n, mesh_is_watertight(t) AS w, mesh_size_x(v) AS x, mesh_size_y(v) AS y, mesh_size_z(v) AS z FROM some_meshes").collect()}
    faced = solid.faced(meshes).selectExpr("element_id", "signed_volume AS s", "volume AS vol", "aggregate(t, 0D, (a, x) -> a + x.area) AS area", "num_edges AS n", "is_watertight AS w", "size_x AS x", "size_y AS y", "size_z AS z")
    want = {r["element_id"]: r for r in faced.collect()}
    assert set(got) == set(want) and len({r["w"] for r in want.values()}) == 2
    for i, r in want.items():
        for c in ("s", "vol", "area", "x", "y", "z"):
            assert got[i][c] == pytest.approx(r[c]), (i, c)
        assert (got[i]["n"], got[i]["w"]) == (r["n"], r["w"])
    assert len(names) == 8
    by = spark.sql("SELECT mesh_is_watertight(t) AS w, sum(mesh_volume(t, v)) AS vol FROM some_meshes WHERE mesh_area(t) > 20 GROUP BY 1").collect()
    for r in by:
        assert r["vol"] == pytest.approx(sum(x["vol"] for x in want.values() if x["w"] == r["w"] and x["area"] > 20))
