"""All anomaly detectors in one table."""

from pyspark.sql import functions as F

from meshwright.operators import anomalies, text

AREAS = ", ".join(f"CAST({n} AS DOUBLE) AS {c}_area" for c, n in (("crown", 4), ("foundation", 4), ("front", 30), ("back", 30), ("end_left", 2), ("end_right", 2), ("unclassified", 0)))


def test_every_detector_finds_its_own(spark):
    face = lambda i, turned: "named_struct('fid', {}, 'x0', {}D, 'y0', {}D, 'z0', {}D, 'x1', {}D, 'y1', {}D, 'z1', {}D, 'x2', {}D, 'y2', {}D, 'z2', {}D)".format(i, *sum([CORNERS[v] for v in (FACES[i] if not turned else FACES[i][::-1])], ()))
    CORNERS, FACES = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)], [(0, 2, 1), (0, 1, 3), (0, 3, 2), (1, 2, 3)]
    mesh = lambda turned: "array(" + ", ".join(face(i, i in turned) for i in range(4)) + ")"
    widths = "transform(sequence(0, 19), i -> named_struct('w', {}))"
    even, step = widths.format("0.3D + (i * i % 5) * 0.001D"), widths.format("IF(i < 10, 0.3D, 0.5D) + (i * i % 5) * 0.001D")
    base = spark.range(9).selectExpr(
        "id AS element_id", "'wall_stem' AS element_role", "1 AS crown_count", "1 AS foundation_count", "IF(id = 1, 0, 1) AS front_count", "1 AS back_count", *AREAS.split(", "), "10D AS size_x", "0.4D AS size_y", "IF(id = 4, 0.1D, 3D) AS size_z",
        "IF(id = 5, 100D, 300D) AS crown_width_mm", "300D AS min_wall_thickness_mm", f"IF(id = 6, {step}, {even}) AS line", f"IF(id = 7, {mesh((0, 1))}, {mesh(())}) AS t",
    )
    rows = base.withColumns({"unclassified_area": F.expr("IF(element_id = 2, 50D, 0D)"), "front_area": F.expr("IF(element_id = 3, 90D, 30D)")})
    rows = rows.withColumn("crown_width_mm", F.expr("IF(element_id = 8, NULL, crown_width_mm)"))
    got = sorted(tuple(r) for r in anomalies.detected(rows).collect())
    names = ["missing_faces", "high_unclassified", "asymmetric_front_back", "extreme_aspect_ratio", "crown_narrower_than_thickness", "profile_step", "inconsistent_normals"]
    assert got == [(i + 1, n) for i, n in enumerate(names)]
    assert anomalies.detected(rows.limit(0)).count() == 0


def test_constants_keep_quotes(spark):
    for value in ("it's", "a\\b", "\\'", "plain"):
        assert spark.range(1).selectExpr(f"{text.of(value)} AS x").first()["x"] == value


def test_detectors_stay_in_a_row(spark, tmp_path):
    """Walls are read once: no detector groups their triangles or slices by a shuffle."""
    from meshwright.operators import classify, measure
    from meshwright.sources import tables

    solids = measure.enriched(classify.classified(tables.meshes(tables.walls(spark, "/root/testdata/sf0.001").where("element_id < 3"))))
    assert "Exchange" not in anomalies.detected(solids)._jdf.queryExecution().executedPlan().toString()
