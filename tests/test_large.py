"""Meshes that needn't fit a row: both plans must give the same."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwright.operators import classify, large, measure, mesh, solid
from meshwright.sources import tables

DATA = "/root/testdata/sf0.001"


def block(spark, n, element, size=(8.0, 1.0, 4.0), at=(0.0, 0.0, 0.0)):
    """A box whose sides are n by n quads, two triangles each; corners are numbered by their place."""
    s = spark.range(6 * n * n * 2).select(F.col("id").cast("int").alias("fid"), F.expr(f"cast(id div {2 * n * n} as int)").alias("side"), F.expr(f"cast(id div 2 % {n} as int)").alias("i"), F.expr(f"cast(id div {2 * n} % {n} as int)").alias("j"), F.expr("cast(id % 2 as int)").alias("half"))
    u, v = {0: (0, 1), 1: (0, 1), 2: (0, 2), 3: (0, 2), 4: (1, 2), 5: (1, 2)}, {0: 2, 1: 2, 2: 1, 3: 1, 4: 0, 5: 0}

    def corner(di, dj):
        cases = []
        for axis in range(3):
            e = F.lit(None)
            for side in range(6):
                own = F.col("i") + di if u[side][0] == axis else F.col("j") + dj if u[side][1] == axis else F.lit(n * (side % 2))
                e = F.when(F.col("side") == side, own).otherwise(e)
            cases.append(e.cast("int"))
        return cases

    out = s
    for name, (di, dj) in {"p": (0, 0), "q": (1, 0), "r": (1, 1), "s": (0, 1)}.items():
        for c, e in zip("xyz", corner(di, dj), strict=True):
            out = out.withColumn(f"{name}{c}", e)
    outward = F.col("side").isin(1, 2, 5)  # the others are wound over
    for k, (plain, turned) in enumerate((("p", "p"), ("q", "r"), ("r", "q"))):
        for c, length, o in zip("xyz", size, at, strict=True):
            first = F.when(outward, F.col(f"{plain}{c}")).otherwise(F.col(f"{turned}{c}"))
            second = F.when(outward, F.col(f"{ {0: 'p', 1: 'r', 2: 's'}[k] }{c}")).otherwise(F.col(f"{ {0: 'p', 1: 's', 2: 'r'}[k] }{c}"))
            out = out.withColumn(f"_{c}{k}", F.when(F.col("half") == 0, first).otherwise(second))
        out = out.withColumn("abc"[k], (F.col(f"_x{k}") * (n + 1) + F.col(f"_y{k}")) * (n + 1) + F.col(f"_z{k}"))
    return out.select(F.lit(element).cast("long").alias("element_id"), "fid", "a", "b", "c", *((F.col(f"_{c}{k}") * (length / n) + o).alias(f"{c}{k}") for k in range(3) for c, length, o in zip("xyz", size, at, strict=True)))


@pytest.fixture(scope="module")
def mixed(spark):
    """Two dense blocks, one of them inside out, and small walls of which some are open or inside out."""
    walls = tables.triangles(tables.walls(spark, DATA))
    over = block(spark, 4, 10_001, at=(1000.0, 2000.0, 5.0)).withColumns({"b": F.col("c"), "c": F.col("b")} | {f"{c}{i}": F.col(f"{c}{3 - i}") for c in "xyz" for i in (1, 2)})
    out = walls.unionByName(block(spark, 8, 10_000)).unionByName(over)
    return out.checkpoint()


def close(a, b):
    for x, y in zip(a, b, strict=True):
        if isinstance(x, float):
            assert x == pytest.approx(y, rel=1e-9, abs=1e-9)
        else:
            assert x == y


def test_level1(spark, mixed):
    few, many = (sorted(map(tuple, large.level1(mixed, limit).collect())) for limit in (10, 10**6))
    some = large.level1(mixed, 500).collect()
    assert len(few) == len(many) == len(some) == 202
    for x, y, z in zip(few, many, sorted(map(tuple, some)), strict=True):
        close(x, y)
        close(x, z)
    b = next(r for r in some if r["element_id"] == 10_000)
    assert (b["num_triangles"], b["num_edges"], b["is_watertight"], b["normals_flipped"]) == (768, 1152, True, False)
    assert b["volume"] == pytest.approx(32) and b["total_area"] == pytest.approx(2 * (8 + 32 + 4)) and b["cx"] == pytest.approx(4)
    assert next(r["normals_flipped"] for r in some if r["element_id"] == 10_001)


def test_groups(spark, mixed):
    few, many = (sorted(map(tuple, large.groups(mixed, limit).collect())) for limit in (10, 10**6))
    assert len(few) == len(many)
    for x, y in zip(few, many, strict=True):
        close(x, y)
    assert large.groups(mixed, 500).where("element_id = 10000").count() == 6


def test_components_across_blocks(spark, mixed):
    t = mixed.where("element_id >= 10000")
    pairs = large.adjacency(t)
    for size in (100, 1 << 16):
        assert {(r["element_id"], r["component"]) for r in large.components(t, pairs, block=size).select("element_id", "component").distinct().collect()} == {(10_000, 0), (10_001, 0)}
    ring = spark.createDataFrame([(1, (i * 37) % 500, ((i + 1) * 37) % 500) for i in range(499)] + [(1, 900, 901)], "element_id long, f int, g int")
    own = spark.createDataFrame([(1, i) for i in [*range(500), 900, 901, 950]], "element_id long, fid int")
    got = {r["fid"]: r["component"] for r in large.components(own, ring, block=64).collect()}
    assert got == {i: 0 for i in range(500)} | {900: 900, 901: 900, 950: 950}


def test_bodies_and_crowns(spark, mixed):
    stepped = tables.stepped(tables.walls(spark, DATA).limit(25)).checkpoint()
    t = stepped.select("element_id", F.inline("t")).checkpoint()
    other = t.withColumns({"fid": F.col("fid") + 100} | {v: F.col(v) + 100 for v in "abc"} | {f"{c}{i}": F.col(f"{c}{i}") * 0.5 + 50 for c in "xyz" for i in range(3)})
    two = t.unionByName(other).checkpoint()
    plain = {r["element_id"]: (r["fid"], round(r["area"], 6), r["num_bodies"]) for r in solid.largest_body(solid.faced(solid.rows(two))).select("element_id", F.col("t")[0]["fid"].alias("fid"), F.expr(solid.total("t", lambda x: x["area"]).__str__()).alias("area"), "num_bodies").collect()}
    got = {r["element_id"]: (r["component"], round(r["area"], 6), r["num_bodies"]) for r in large.largest_body(two).collect()}
    assert {k: (v[0], pytest.approx(v[1], abs=2e-6), v[2]) for k, v in got.items()} == plain
    width = {r["element_id"]: r["crown_width_mm"] for r in large.crown_width(two, by_area=True).collect()}
    assert width == {k: pytest.approx(v) for k, v in crown_widths(t.collect()).items()} and len(width) == 25
    # where a wall is straight, as the array plan has it
    walls = tables.meshes(tables.walls(spark, DATA).where("element_id % 13 <> 5").limit(20)).checkpoint()
    want = {r["element_id"]: r["crown_width_mm"] for r in measure.with_level3(classify.classified(walls)).select("element_id", "crown_width_mm").collect()}
    width = {r["element_id"]: r["crown_width_mm"] for r in large.crown_width(walls.select("element_id", F.inline("t"))).collect()}
    assert width == {k: pytest.approx(v) for k, v in want.items()}


def crown_widths(rows):
    """By numpy: the highest level faces across the main axis of the area-weighted centroids."""
    out = {}
    for e in {r["element_id"] for r in rows}:
        p = np.array([[[r[f"{c}{i}"] for c in "xyz"] for i in range(3)] for r in rows if r["element_id"] == e])
        n = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
        area, mid = np.linalg.norm(n, axis=1) / 2, p.mean(1)[:, :2]
        off = mid - (mid * area[:, None]).sum(0) / area.sum()
        _, v = np.linalg.eigh((off * area[:, None]).T @ off / area.sum())
        top = p[(n[:, 2] > 0.99 * 2 * area) & (p[:, :, 2].min(1) > p[:, :, 2].max() - 0.1)]
        across = top[:, :, 0] * v[1, 1] - top[:, :, 1] * v[0, 1]
        out[e] = np.ptp(across) * 1000
    return out


def test_degenerate_and_quality(spark, mixed):
    flat = mixed.where("fid = 0").withColumns({"fid": F.lit(99_999), "c": F.col("a")} | {f"{c}2": F.col(f"{c}0") for c in "xyz"})
    out = mesh.drop_degenerate(mixed.unionByName(flat))
    assert out.count() == mixed.count() and {r["n_degenerate"] for r in out.select("n_degenerate").distinct().collect()} == {1}
    q = {r["element_id"]: r for r in mesh.quality(mixed).collect()}[10_000]
    assert q["num_triangles"] == 768 and q["min_area"] == pytest.approx(1 / 8 * 0.5 / 2) and q["median_area"] == pytest.approx(1 * 0.125 / 2) and q["max_edge"] == pytest.approx((1 + 0.5**2) ** 0.5)


def test_empty(spark, mixed):
    assert large.level1(mixed.limit(0)).count() == 0 and large.groups(mixed.limit(0)).count() == 0
