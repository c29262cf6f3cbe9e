"""Components of a row's graph without Python: against the batched closing in numpy, and no Python in the plans that use them."""

import random

import pandas as pd
from meshwright.operators import classify, solid
from meshwright.sources import tables


def graphs():
    r = random.Random(4)
    out = [(0, []), (1, []), (5, [(0, 1), (3, 4)]), (4, [(2, 3), (1, 2), (0, 1), (0, 0)])]
    for n in (2, 12, 31, 32, 33, 60, 400):
        for share in (0.3, 0.8, 2.0):
            out.append((n, [(r.randrange(n), r.randrange(n)) for _ in range(int(n * share))]))
    for n in (30, 500):  # chains: in order, against it, and shuffled; a star about its last node
        mixed = r.sample(range(n), n)
        out += [(n, [(i, i + 1) for i in range(n - 1)]), (n, [(i + 1, i) for i in range(n - 1)][::-1]), (n, list(zip(mixed, mixed[1:], strict=False))), (n, [(i, n - 1) for i in range(n)])]
    return out


def test_components_are_those_of_the_batch(spark):
    rows = [(k, n, [{"f": a, "g": b} for a, b in p]) for k, (n, p) in enumerate(graphs())]
    df = spark.createDataFrame(rows, "k int, n int, p array<struct<f:int,g:int>>")
    got = {r["k"]: r["c"] for r in df.select("k", solid.components(solid.Column("p"), solid.Column("n")).alias("c")).collect()}
    for k, n, p in rows:
        want = solid.closed.func(pd.Series([n]), pd.Series([[x["f"] for x in p]]), pd.Series([[x["g"] for x in p]]))[0]
        assert got[k] == list(want), k


def test_classification_has_no_python(spark):
    plan = classify.classified(tables.meshes(tables.walls(spark, "/root/testdata/sf0.001")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
