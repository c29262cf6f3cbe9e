"""Operators that stay even when one group, box or mesh is large, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwright.operators import ordered, pairs, select, spread, stats, terrain


def test_order_statistics(spark):
    r = random.Random(1)
    groups = {
        "smooth": [r.gauss(0, 1) for _ in range(4000)], "ties": [float(r.randrange(3)) for _ in range(3000)], "same": [5.0] * 900,
        "wide": [r.choice([-1, 1]) * 10.0 ** r.randrange(-300, 300) for _ in range(1500)], "ends": [-1.7e308, 1.7e308] + [r.random() for _ in range(800)],
        "few": [3.0, 1.0, 2.0], "one": [4.0], "even": [1.0, 2.0, 10.0, 20.0] * 200,
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [("smooth", None), ("none", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    q = {"a": 0.0, "low": 0.1, "median": 0.5, "high": 0.93, "z": 1.0}
    for few, parts in ((50, 16), (10, 1024), (100_000, 8)):
        got = {x["g"]: x for x in select.order_statistics(df, "g", "v", q, few, parts).collect() if x["g"] is not None}
        assert set(got) == set(groups)
        for g, values in groups.items():
            assert got[g]["n"] == len(values)
            s = sorted(values)
            for name, at in q.items():
                place = at * (len(s) - 1)
                lo = int(place)
                a, b = s[lo], s[min(lo + 1, len(s) - 1)]
                want = a + (b - a) * (place - lo) if a != b else a
                assert got[g][name] == pytest.approx(want, rel=1e-12, abs=1e-300), (g, name, few)


def test_statistics_of_large_groups_equal_those_of_small(spark):
    r = random.Random(2)
    df = spark.createDataFrame([("ab"[i % 2], i, r.choice([None, 0.0, r.gauss(5, 1), r.gauss(5, 1), r.gauss(5, 40)])) for i in range(5000)], "g string, id long, value double")
    key = lambda x: (x["g"], x.asDict().get("id", 0))
    for of in (lambda few: stats.distribution(df, "g", few=few), lambda few: stats.mad_outliers(df, "g", "id", few=few)):
        a, b = sorted(of(100).collect(), key=key), sorted(of(100_000).collect(), key=key)
        assert len(a) == len(b) > 1 and all(list(map(str, x))[:2] == list(map(str, y))[:2] for x, y in zip(a, b, strict=True))
        assert np.allclose([[v for v in x if isinstance(v, float)] for x in a], [[v for v in y if isinstance(v, float)] for y in b], rtol=1e-9)


def test_attach_deals_hot_keys(spark):
    big = spark.createDataFrame([(0 if i % 3 else i % 50, i) for i in range(3000)], "k long, v long")
    small = spark.createDataFrame([(k, str(k)) for k in range(40)], "k long, name string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        names = ["k", "v"] if how.endswith(("semi", "anti")) else ["k", "v", "name"]
        plain = sorted(map(tuple, big.join(small, "k", how).select(names).collect()), key=str)
        dealt = spread.attach(big, small, ["k"], how, rows=5, salts=8)
        assert sorted(map(tuple, dealt.select(names).collect()), key=str) == plain
        assert sorted(map(tuple, spread.attach(big, small, ["k"], how).select(names).collect()), key=str) == plain


def test_following_rows_across_parts(spark):
    r = random.Random(3)
    rows = [("hot" if i % 3 else f"g{i % 40}", r.randrange(50), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, pos int, id int").repartition(5)
    want = {}
    for g in {x[0] for x in rows}:
        own = sorted((x[1], x[2]) for x in rows if x[0] == g)
        want |= {a[1]: b for a, b in zip(own, [*own[1:], None], strict=True)}
    got = {x["id"]: (x["next"]["pos"], x["next"]["id"]) if x["next"] else None for x in ordered.following(df, ["g"], ["pos", "id"], 7).collect()}
    assert got == want
    assert ordered.following(df.limit(0), ["g"], ["pos", "id"]).count() == 0


def boxes_of(rows):
    return [(i, f"m{i % 2}", x, y, z, x + w, y + d, z + h) for i, (x, y, z, w, d, h) in enumerate(rows)]


_BOX = "element_id long, model_id string, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double"


def test_boxes_of_mixed_size(spark):
    r = random.Random(4)
    rows = [(r.uniform(-60, 60), r.uniform(-60, 60), r.uniform(0, 3), *(r.choice([0.0, 0.3, 2.0, 30.0]) * r.random() for _ in range(3))) for _ in range(250)] + [(-5000.0, -5000.0, 0.0, 10_000.0, 10_000.0, 1.0)] * 2
    b = boxes_of(rows)
    df = spark.createDataFrame(b, _BOX)
    near = lambda p, q, reach: all(max(0.0, max(p[2 + c], q[2 + c]) - min(p[5 + c], q[5 + c])) <= reach for c in range(3))
    for reach in (0.0, 1.5):
        want = sorted((p[0], q[0]) for i, p in enumerate(b) for q in b[i + 1 :] if near(p, q, reach))
        got = pairs.box_pairs(df, reach).collect()
        assert sorted((x["a_id"], x["b_id"]) for x in got) == want
        assert all(x["a_min_x"] == b[x["a_id"]][2] and x["b_max_z"] == b[x["b_id"]][7] and x["gap_x"] >= 0 for x in got)
        same = sorted(p for p in want if p[0] % 2 == p[1] % 2)
        assert sorted((x["a_id"], x["b_id"]) for x in pairs.box_pairs(df, reach, group="model_id").collect()) == same


def test_a_box_costs_few_rows_at_each_level(spark):
    from meshwright.operators import grid

    df = spark.createDataFrame(boxes_of([(0.0, 0.0, 0.0, 10_000.0, 9_000.0, 1.0), *((float(i), 0.0, 0.0, 0.5, 0.5, 0.5) for i in range(50))]), _BOX)
    around = {c: (F.col(f"min_{c}"), F.col(f"max_{c}")) for c in "xy"}
    leveled = grid.resident(df, around)
    for at in grid.levels(leveled):
        most = grid.cells(leveled.where(F.col("_level") <= at), F.lit(at), around).groupBy("element_id").count().agg(F.max("count")).first()[0]
        assert most <= 9


def test_vertex_distances_of_many_vertices(spark):
    r = np.random.default_rng(5)
    verts, at = [], {}
    for e in range(6):
        n = [5, 3000, 2500, 8, 900, 4000][e]
        p = r.random((n, 3)) * [8, 1, 4] + [e * 7.0, e % 2, 0]
        p[np.arange(n), r.integers(0, 3, n)] = np.round(p[np.arange(n), r.integers(0, 3, n)])  # on planes, as surfaces are
        at[e] = p
        verts += [(e, i, *map(float, x)) for i, x in enumerate(p)]
    v = spark.createDataFrame(verts, "element_id long, vid long, x double, y double, z double")
    met = [(a, b) for a in range(6) for b in range(a + 1, 6)]
    df = spark.createDataFrame(met, "a_id long, b_id long")
    got = {(x["a_id"], x["b_id"]): x["min_distance_mm"] for x in pairs.vertex_distances(df, v).collect()}
    for a, b in met:
        assert got[a, b] == pytest.approx(np.sqrt(((at[a][:, None] - at[b][None]) ** 2).sum(2).min()) * 1000, abs=0.051)


def test_compared_vertices_grow_with_their_number(spark):
    """Two blocks a little apart: four times the vertices on their sides give some four times the comparisons, not sixteen."""
    r = np.random.default_rng(8)

    def seen(n, gap):
        verts = []
        for e in range(2):
            p = r.random((n, 3)) * [8, 1, 4]
            k = r.integers(0, 3, n)
            p[np.arange(n), k] = np.array([8, 1, 4])[k] * r.integers(0, 2, n)
            verts += [(e, *map(float, x + [e * (8 + gap), 0, 0])) for x in p]
        v = spark.createDataFrame(verts, "element_id long, x double, y double, z double")
        cells, placed = pairs.vertex_candidates(spark.createDataFrame([(0, 1)], "a_id long, b_id long"), v)
        n = placed.groupBy("element_id", "_cell").count()
        met = cells.join(n.selectExpr("element_id AS a_id", "_cell AS _a", "count AS p"), ["a_id", "_a"]).join(n.selectExpr("element_id AS b_id", "_cell AS _b", "count AS q"), ["b_id", "_b"])
        return met.agg(F.sum(F.col("p") * F.col("q"))).first()[0]

    for gap in (0.5, 15.0):
        few, many = seen(2000, gap), seen(8000, gap)
        assert many < 8 * few and many < 8000 * 8000 / 50, (gap, few, many)


def test_nearest_vertex_of_long_lines(spark):
    r = np.random.default_rng(6)
    line = [(l, i, float(x), float(y)) for l in range(4) for i, (x, y) in enumerate(np.cumsum(r.standard_normal((700, 2)), 0) + l * 20)]
    line += [(9, i, 5.0, 5.0) for i in range(3)]  # equal vertices: the first counts
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.vstack([r.standard_normal((200, 2)) * 40, r.standard_normal((60, 2)) * 4000, [[5.0, 5.0]]]))]
    df, ln = spark.createDataFrame(pts, "element_id long, x double, y double"), spark.createDataFrame(line, "line_id long, i int, lx double, ly double")
    xy, ids = np.array([v[2:] for v in line]), [v[:2] for v in line]
    got = {x["element_id"]: (x["line_id"], x["i"], x["distance_m"]) for x in terrain.nearest_vertex(df, ln).collect()}
    for i, x, y in pts:
        d = ((xy - [x, y]) ** 2).sum(1)
        k = min(range(len(ids)), key=lambda j: (d[j], ids[j]))
        assert got[i][:2] == ids[k] and got[i][2] == pytest.approx(np.sqrt(d[k]))
    assert terrain.nearest_vertex(df, ln.limit(0)).count() == 0
    assert {x["line_id"] for x in terrain.nearest_vertex(df, ln.where("line_id = 9 AND i = 1")).collect()} == {9}


def test_alignment_context_of_models(spark):
    arc = [(m, 1, i, 100.0 * (m + 1) * np.cos(i / 40), 100.0 * (m + 1) * np.sin(i / 40)) for m in range(2) for i in range(60)]
    ln = spark.createDataFrame([tuple(map(lambda v: v.item() if hasattr(v, "item") else v, a)) for a in arc], "model_id int, line_id long, i int, lx double, ly double")
    w = spark.createDataFrame([(0, 1, 99.0, 1.0, 50.0), (1, 2, 99.0, 1.0, 50.0), (1, 3, 200.0, 5.0, None)], "model_id int, element_id long, x double, y double, min_radius_m double")
    got = {x["element_id"]: x for x in terrain.alignment_context(w, ln, group="model_id").collect()}
    assert got[1]["radius"] == pytest.approx(100) and got[1]["radius_ratio"] == pytest.approx(0.5)
    assert got[2]["radius"] == pytest.approx(200) and got[2]["radius_ratio"] == pytest.approx(0.25) and got[2]["distance_m"] > 90
    assert got[3]["radius_ratio"] is None


def test_heights_over_triangles_of_mixed_size(spark):
    r = np.random.default_rng(7)
    tri = [(0, "a", -9000.0, -9000.0, 1.0, 9000.0, -9000.0, 1.0, 0.0, 9000.0, 1.0), (1, "b", -9000.0, -9000.0, 7.0, 9000.0, -9000.0, 7.0, 0.0, 9000.0, 7.0)]
    tri += [(2 + i, "a", x, y, 2.0, x + 0.5, y, 2.0, x, y + 0.5, 2.0) for i, (x, y) in enumerate((r.random((300, 2)) * 40 - 20).tolist())]
    t = spark.createDataFrame(tri, "fid int, model_id string, " + ", ".join(f"{c}{i} double" for i in range(3) for c in "xyz"))
    p = spark.createDataFrame([(i, "ab"[i % 2], float(x), float(y)) for i, (x, y) in enumerate(np.vstack([r.random((300, 2)) * 40 - 20, [[1e5, 0.0], [5000.0, -8000.0]]]))], "id int, model_id string, x double, y double")
    every = {x["id"]: x["terrain_z"] for x in terrain.heights(p, t).collect()}
    assert every[300] is None and all(v == pytest.approx(1.0) for i, v in every.items() if i != 300)  # the first triangle by number
    own = {x["id"]: x["terrain_z"] for x in terrain.heights(p, t, group="model_id").collect()}
    assert all(own[i] == pytest.approx(7.0 if i % 2 else 1.0) for i in own if i != 300)
    small = {x["id"]: x["terrain_z"] for x in terrain.heights(p, t.where("fid > 1")).collect()}
    want = lambda x, y: any(px <= x and py <= y and (x - px) + (y - py) <= 0.5 for _, _, px, py, *_ in tri[2:])
    assert all((small[q["id"]] is not None) == want(q["x"], q["y"]) for q in p.collect())


def test_meshes_are_dealt_by_their_triangles(spark, monkeypatch):
    from meshwright.operators import spread
    from meshwright.sources import tables

    walls = tables.walls(spark, "/root/testdata/sf0.01")
    n = walls.count()
    plain = tables.meshes(walls.limit(100)).rdd.getNumPartitions()
    many = tables.meshes(walls)
    assert plain == 1 and many.rdd.getNumPartitions() == -(-n * 12 // spread.TASK_TRIANGLES) > 1
    assert many.count() == n and many._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1
    assert tables.bent(walls).rdd.getNumPartitions() == spread.WAVES * spark.sparkContext.defaultParallelism or tables.bent(walls).rdd.getNumPartitions() == -(-n * 196 // spread.TASK_TRIANGLES)
    assert spread.dealt(walls.limit(0), "element_id", 12).count() == 0
