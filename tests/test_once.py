"""Expressions over arrays compute their arguments once, and sort numbers where ids allow it."""

from meshwright.operators import measure, solid
from meshwright.operators import text as F
from meshwright.sources import tables


def test_polylines_are_computed_once():
    for of in (solid.segments, solid.turns):
        assert of(F.col("polyline")).text.count("polyline") == 1
    assert solid.bends(F.col("polyline")).text.count("polyline") <= 2  # its size is asked besides
    assert measure.slice_tolerance(F.col("polyline")).text.count("polyline") <= 2


def test_sides_and_corners_of_large_ids(spark):
    """Ids beyond those that make a side one number give the same sides, pairs and corners."""
    few = tables.meshes(tables.walls(spark, "/root/testdata/sf0.001").limit(5)).select("element_id", "t")
    names = ", ".join(f"'{c}', x.{c}" for c in ("fid",))
    corner = ", ".join(f"'{c}', x.{c}" for c in solid.CORNER)
    ids = lambda by: ", ".join(f"'{v}', x.{v} + {by}" for v in "abc")
    shifted = lambda by: few.selectExpr("element_id", f"transform(t, x -> named_struct({names}, {ids(by)}, {corner})) AS t")

    def read(rows):
        out = F.put(rows, {"e": solid.edges(F.col("t")), "p": F.transform(solid.corners(F.col("t")), lambda p: F.array(p["x"], p["y"], p["z"]))})
        return sorted(map(tuple, out.select("element_id", "e", "p").collect()))

    assert read(shifted("0L")) == read(shifted("3000000L")) == read(shifted("9000000000L")) == read(shifted("-4L"))


def test_gathered_places_by_label(spark):
    rows = spark.sql("SELECT array(0, 1, 0, 3, 1) AS label")
    out = F.put(rows, {"g": solid.gathered(F.col("label"), lambda g, at: solid.structs(g=g, at=at))}).first()["g"]
    assert [(r["g"], r["at"]) for r in out] == [(0, [0, 2]), (1, [1, 4]), (3, [3])]
