"""Rules, model files, reports and the entry module on small cases of known result."""

import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from meshwright.operators import classify, context, graph, measure, pairs, solid, stats, terrain
from meshwright.report import sinks
from meshwright.rules.compiler import RuleError, compile_rule
from meshwright.rules.evaluate import evaluate, summary
from meshwright.rules.rulesets import TEXT, ruleset
from meshwright.sources import tables

BOX = """ISO-10303-21;
DATA;
#2=IFCSIUNIT(*,.LENGTHUNIT.,{unit},.METRE.);
#6=IFCCARTESIANPOINT((10.,20.,0.));
#9=IFCAXIS2PLACEMENT3D(#6,$,$);
#18=IFCRECTANGLEPROFILEDEF(.AREA.,$,$,8.,0.4);
#19=IFCDIRECTION((0.,0.,1.));
#20=IFCEXTRUDEDAREASOLID(#18,$,#19,3.);
#21=IFCSHAPEREPRESENTATION(#11,'Body','SweptSolid',(#20));
#22=IFCPRODUCTDEFINITIONSHAPE($,$,(#21));
#25=IFCLOCALPLACEMENT($,#9);
#16=IFCWALL('1Gecrp6694PgofkkkEXkMl',$,'M\\X2\\00FC\\X0\\ller''s, wall',$,$,#25,#22,$,.RETAININGWALL.);
ENDSEC;
"""


@pytest.fixture(scope="module")
def models(spark, tmp_path_factory):
    from meshwright.api import Models

    d = tmp_path_factory.mktemp("models")
    (d / "metre.ifc").write_text(BOX.format(unit="$"))
    (d / "milli.ifc").write_text(BOX.format(unit=".MILLI."))
    (d / "empty.ifc").write_text("no model\n")
    return Models(spark, str(d))


def test_model_files(models):
    rows = {r["model_id"]: r for r in models.elements.collect()}
    assert rows["metre"]["name"] == "Müller's, wall" and rows["metre"]["predefined_type"] == "RETAININGWALL"
    assert [r["model_id"] for r in models.errors.collect()] == ["empty"]
    m = {r["element_id"]: r for r in models.measurements.collect()}
    one = m["metre#16"]
    assert one["volume"] == pytest.approx(9.6) and one["mesh_is_watertight"]
    assert one["crown_width_mm"] == pytest.approx(400) and one["min_wall_thickness_mm"] == pytest.approx(400)
    assert one["crown_slope_percent"] == pytest.approx(0, abs=1e-6) and one["element_role"] == "wall_stem" and one["is_plumb"]
    assert m["milli#16"]["volume"] == pytest.approx(9.6e-9)
    low = models.vertices.where("element_id = 'metre#16'").agg(F.min("x"), F.min("y")).first()
    assert (low[0], low[1]) == (pytest.approx(6), pytest.approx(19.8))


def test_checks_of_files(models):
    v = {r["element_id"]: r for r in models.verdicts().collect()}["metre#16"]
    assert v["total"] == 18 and v["passed"] + v["failed"] + v["skipped"] == 18


WANTED = [
    ("a > 1 and b < 5", "PASS"), ("a > 1 and none > 1", "SKIP"), ("a > 100 and none > 1", "SKIP"), ("a > 1 or none > 1", "SKIP"), ("1 < a < 0 < none", "FAIL"), ("1 < a < none", "SKIP"), ("a / zero > 1", "SKIP"),
    ("-7 // 2 == -4", "PASS"), ("-7 % 3 == 2", "PASS"), ("2 ** 3 == 8", "PASS"), ("flag == true", "PASS"), ("flag + 1 == 2", "PASS"), ("not flag", "FAIL"), ("abs(-a) == a", "PASS"), ("a", "PASS"), ("zero", "FAIL"), ("unknown > 1", "SKIP"),
    ("a.real > 0", "SKIP"), ("__import__('os')", "SKIP"), ("[1][0] > 0", "SKIP"), ("a >", "SKIP"), ("'x' == 'x'", "SKIP"), ("a if flag else b", "SKIP"),
]


@pytest.mark.parametrize(("check", "status"), WANTED)
def test_rule(spark, check, status):
    row = spark.createDataFrame([(1, 2.0, 3.0, None, 0.0, True)], "element_id int, a double, b double, none double, zero double, flag boolean")
    assert evaluate(row, {"level_1": [{"id": "R", "check": check}]}).first()["status"] == status


def test_rule_language_is_closed():
    for text in ("open('x')", "a.b", "lambda: 1", "a[0]", "{1}", "f'{a}'", "abs(a, b)", "max(a)"):
        with pytest.raises(RuleError):
            compile_rule(text, ["a", "b"])


def test_roles_and_composites(spark):
    rows = spark.createDataFrame([(1, 1.0, "slab", False), (2, 1.0, "wall_stem", True), (3, 0.0, None, None)], "element_id int, v double, element_role string, is_wall_like boolean")
    rules = {
        "level_1": [{"id": "A", "check": "v > 0"}], "level_3": [{"id": "B", "check": "v > 0"}, {"id": "C", "check": "v > 0", "applies_to": ["slab"]}],
        "level_4": [{"id": "D", "depends_on": ["A"]}, {"id": "E", "depends_on": ["D", "B"]}, {"id": "F", "depends_on": []}, {"id": "G", "depends_on": ["nowhere"]}],
    }
    c = evaluate(rows, rules)
    got = {i: "".join(r["status"][0] for r in sorted(c.where(f"element_id = {i}").collect(), key=lambda r: r["seq"])) for i in (1, 2, 3)}
    assert got == {1: "PSPPSPS", 2: "PPSPPPS", 3: "FFSFFPS"}
    assert summary(c).where("element_id = 1").first()["skipped"] == 3


def test_rulesets():
    assert {k: sum(map(len, ruleset(k).values())) for k in TEXT} == {"complete": 35, "noise_barrier": 6, "retaining_wall": 18, "tunnel": 9, "abutment": 9, "retaining_wall_sia": 8}
    for name in TEXT:
        for level, rules in ruleset(name).items():
            for r in rules:
                assert level == "level_4" or compile_rule(r["check"], ["volume"])


def test_far_cube_volume(spark):
    w = spark.createDataFrame([(1, 1.0, 1.0, 1.0, 2.6e6, 1.2e6, 500.0, 0.0, 0.0)], "element_id int, l double, t double, h double, x0 double, y0 double, z0 double, dy double, dz double")
    row = solid.faced(tables.meshes(w)).selectExpr("*", f"{solid.total('t', lambda x: x['area'])} AS area").first()
    assert row["volume"] == pytest.approx(1, abs=1e-9) and row["area"] == pytest.approx(6, abs=1e-6)


def test_rows_of_triangles_are_the_derived_ones(spark):
    w = tables.walls(spark, "/root/testdata/sf0.001").limit(20)
    a, b = (solid.faced(x).select("element_id", "volume", "is_watertight", "size_z").collect() for x in (tables.meshes(w), solid.rows(tables.triangles(w))))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_rules_take_one_scan_and_no_shuffle(spark):
    from meshwright.plans import walls

    plan = walls.rule_checks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 0 and plan.count("FileScan") == 1


def test_components_of_a_batch(spark):
    import pandas as pd

    close = solid.closed.func
    got = close(pd.Series([5, 1, 4]), pd.Series([[0, 3], [], [2, 1, 0]]), pd.Series([[1, 4], [], [3, 2, 1]]))
    assert [list(x) for x in got] == [[0, 0, 2, 3, 3], [0], [0, 0, 0, 0]]
    chain = list(range(2000))
    assert set(close(pd.Series([2001]), pd.Series([chain[::-1]]), pd.Series([[x + 1 for x in chain[::-1]]]))[0]) == {0}


def test_topmost_and_hull(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.1, 2.0]), (2, [0.0, 1.0, 2.0, 3.0]), (3, [5.0]), (4, [1.0, 1.0]), (5, [])], "k int, z array<double>")
    got = {r["k"]: r["u"] for r in rows.selectExpr("k", f"{solid.topmost(solid.Column('z'), lambda z: z)} AS u").collect()}
    assert got == {1: [2.0], 2: [0.0, 1.0, 2.0, 3.0], 3: [5.0], 4: [1.0, 1.0], 5: []}
    pts = spark.createDataFrame([([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (1.0, 1.0), (1.0, 0.0), (2.0, 2.0)],), ([(0.0, 0.0), (1.0, 1.0)],)], "p array<struct<x:double,y:double>>")
    assert [len(r[0]) for r in pts.selectExpr(f"{measure.hull(solid.Column('p'))} AS h").collect()] == [4, 2]


def test_centreline_of_polylines(spark):
    import math as m

    arc = [(10 * m.cos(a / 10), 10 * m.sin(a / 10)) for a in range(11)]
    lines = spark.createDataFrame([(1, arc), (2, [(0.0, 0.0), (3.0, 4.0)]), (3, [(0.0, 0.0)])], "k int, points array<struct<x:double,y:double>>")
    got = {r["k"]: r for r in measure.with_curvature(solid.from_polyline(lines)).collect()}
    assert set(got) == {1, 2} and got[1]["is_curved"] and not got[2]["is_curved"] and got[2]["wall_length_m"] == 5
    assert got[1]["min_radius_m"] == pytest.approx(10, abs=0.05) and got[1]["mean_radius_m"] == pytest.approx(10, abs=0.05) and got[2]["min_radius_m"] is None


def test_nearest_terrain_point(spark):
    ground = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 3.0, 0.0, 0.0, 0.0, 3.0, 0.0), (1, 60.0, 0.0, 0.0, 63.0, 0.0, 0.0, 60.0, 3.0, 0.0)], "fid int, " + ", ".join(f"{c}{i} double" for i in range(3) for c in "xyz"))
    p = spark.createDataFrame([(1, 30.0, 1.0, 0.0), (2, 200.0, 0.0, 0.0), (3, 55.0, 1.0, 5.0), (4, -48.0, 1.0, 0.0)], "id int, x double, y double, z double")
    assert {r["id"]: r["tx"] for r in terrain.nearest_point(p, ground).collect()} == {1: 1.0, 2: None, 3: 61.0, 4: 1.0}


def test_context_of_stacked_pairs_takes_the_last(spark):
    box = "element_id int, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double"
    b = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 4.0, 1.0, 3.0), (2, -0.5, -0.5, -0.5, 4.5, 1.5, 0.0), (3, 0.0, 0.0, 3.0, 4.0, 1.0, 6.0)], box)
    w = b.selectExpr("element_id", "max_x - min_x AS l", "max_y - min_y AS t", "max_z - min_z AS h", "min_x AS x0", "min_y AS y0", "min_z AS z0", "0D AS dy", "0D AS dz")
    faces = solid.faced(tables.meshes(w)).select("element_id", F.inline("t"))
    got = {r["element_id"]: (r["foundation_extends_beyond_wall"], r["wall_foundation_gap_mm"]) for r in context.stacked(pairs.contact(pairs.box_pairs(b, 1.0), faces)).collect()}
    assert got == {1: (True, 0.0), 2: (True, 0.0), 3: (True, 0.0)}


def test_fix_directions_and_messages(spark):
    row = spark.createDataFrame([(1, 250.0, 4.0)], "element_id int, crown_width_mm double, crown_slope_percent double")
    got = [r["message"] for r in evaluate(row, {"level_1": [{"id": "A", "check": "crown_width_mm >= 300"}, {"id": "B", "check": "crown_slope_percent <= 3.5"}]}).collect()]
    assert "verbreitern (~50.0 Einheiten)" in got[0] and "flacher neigen (~0.5 Einheiten)" in got[1]


def test_propagate(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "f int, g int")
    assert {(r["node"], r["component"]) for r in graph.propagate(chain).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def test_empty_meshes(spark):
    t = spark.createDataFrame([], "element_id int, fid int, a int, b int, c int, " + ", ".join(f"{c}{i} double" for i in range(3) for c in "xyz"))
    s = classify.classified(solid.rows(t))
    assert measure.context(s).count() == measure.planarity(s).count() == 0


def test_boxes_apart_and_polygon(spark):
    b = spark.range(50).selectExpr("id AS element_id", "id * 10D AS min_x", "0D AS min_y", "0D AS min_z", "id * 10D + 0.5D AS max_x", "0.5D AS max_y", "0.5D AS max_z")
    assert pairs.box_pairs(b, 1.0).count() == 0 and pairs.box_pairs(b, 9.5).count() == 49
    p = spark.createDataFrame([(0.0, 1.0), (3.9, 4.4), (4.1, 1.0), (0.0, -0.1)], "x double, y double")
    got = terrain.in_polygon(p, terrain.road_clearance()).collect()
    assert [r["inside"] for r in got] == [True, True, False, False] and got[0]["depth"] == pytest.approx(1.0)
    assert terrain.pedestrian_clearance()[2] == (0.75, 2.5)


def test_distances_of_large_ids(spark, tmp_path):
    from meshwright.plans import site

    spark.createDataFrame([(k, "n", "b", "t", 1) for k in (999_999, 1_000_000, 1_000_001)], "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    assert [(r["a_id"], r["b_id"]) for r in site.element_distances(spark, str(tmp_path)).collect()] == [(1_000_000, 1_000_001)]
    assert {r["element_id"] for r in site.nearest_neighbor_distance(spark, str(tmp_path)).collect()} == {1_000_000, 1_000_001}


def test_steps_need_five_values(spark):
    p = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([400] * 6 + [402, 399, 401] + [600] * 8)] + [(2, i, 1.0) for i in range(4)], "g int, i int, value double")
    got = stats.profile_steps(p.withColumn("value", F.col("value") + F.col("i") % 2), "g", ["i"]).collect()
    assert [r["g"] for r in got] == [1] and math.isclose(got[0]["step"], 199, abs_tol=3)


def test_reports(spark, tmp_path, models):
    m, c = models.measurements, models.checks()
    doc = json.loads(sinks.json_report(m, c).where("element_id = 'metre#16'").first()["report"])
    assert doc["measurements"]["front_inclination_ratio"] == "vertical" and len(doc["checks"]) == 18
    n = sinks.write_bcf(c, str(tmp_path / "a.bcf"))
    assert len(set(zipfile.ZipFile(tmp_path / "a.bcf").namelist())) == n + 1
    scene = json.loads(sinks.viewer(models.solids, c).where("element_id = 'metre#16'").first()["scene"])
    assert len(scene["mesh"]["vertices"]) == 8 and len(scene["checks"]) == 18
    assert n and len(zipfile.ZipFile(tmp_path / "a.bcf").namelist()) == n + 1
    sinks.write_ids(ruleset("retaining_wall"), str(tmp_path / "a.ids"))
    assert "minInclusive" in (tmp_path / "a.ids").read_text()
    sinks.write_html(c, str(tmp_path / "a.html"))
    assert "<table>" in (tmp_path / "a.html").read_text()
    assert sinks.csv_table(m, summary(c)).count() == 2
    assert sinks.rules_table(spark, ruleset("tunnel")).count() == 9


PLACE = """ISO-10303-21;
DATA;
#1=IFCPROJECTEDCRS('EPSG:2056','LV95','CH1903+','LN02',$,$,$);
#2=IFCMAPCONVERSION(#90,#1,2600000.,1200000.,400.,1.,0.,1.);
#3=IFCALIGNMENT('a',$,'road',$,$,$,$,$);
#4=IFCALIGNMENTHORIZONTAL('h',$,$,$,$,$,$);
#5=IFCRELNESTS('r',$,$,$,#3,(#4));
#6=IFCCARTESIANPOINT((0.,0.));
#7=IFCCARTESIANPOINT((10.,0.));
#8=IFCALIGNMENTHORIZONTALSEGMENT($,$,#6,0.,0.,0.,10.,$,.LINE.);
#9=IFCALIGNMENTHORIZONTALSEGMENT($,$,#7,0.,20.,20.,15.,$,.CIRCULARARC.);
#10=IFCALIGNMENTSEGMENT('s',$,$,$,$,$,$,#8);
#11=IFCALIGNMENTSEGMENT('t',$,$,$,$,$,$,#9);
#12=IFCRELNESTS('q',$,$,$,#4,(#10,#11));
#20=IFCWALLSTANDARDCASE('w',$,'Stützwand',$,$,$,$,$,.NOTDEFINED.);
#21=IFCWALLTYPE('y',$,'T',$,$,$,$,$,$,.RETAININGWALL.);
#22=IFCRELDEFINESBYTYPE('z',$,$,$,(#20),#21);
ENDSEC;
"""


def test_place_of_a_model(spark, tmp_path):
    from meshwright.api import Models

    (tmp_path / "place.ifc").write_text(PLACE)
    (tmp_path / "plain.ifc").write_text(BOX.format(unit="$"))
    m = Models(spark, str(tmp_path))
    c = {r["model_id"]: r for r in m.coordinate_systems.collect()}
    assert c["place"]["name"] == "EPSG:2056" and c["place"]["eastings_offset"] == 2600000 and c["place"]["has_crs"]
    assert c["plain"]["name"] == "unspecified" and not c["plain"]["has_crs"] and c["plain"]["eastings_offset"] is None
    p = sorted((r["i"], r["lx"], r["ly"]) for r in m.alignments.collect())
    assert len(p) == 2 + 16 and p[1][1:] == (10.0, 0.0) and p[-1][1] == pytest.approx(10 + 20 * math.sin(0.75)) and p[-1][2] == pytest.approx(20 - 20 * math.cos(0.75))
    e = {r["element_id"]: r for r in m.elements.collect()}
    assert e["place#20"]["predefined_type"] == "RETAININGWALL" and e["place#20"]["entity_type"] == "IFCWALLSTANDARDCASE" and e["plain#16"]["predefined_type"] == "RETAININGWALL"


def test_folder_stream(spark, tmp_path):
    from meshwright.streaming.watch import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.ifc").write_text(BOX.format(unit="$"))
    watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 18


def test_entry_without_the_optional_part(spark):
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') and k[2].isdigit() for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
