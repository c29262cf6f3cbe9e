"""Whitening against numpy's eigenvectors of the covariance formed in whole."""

import numpy as np
import pytest

from meshwright.llm import whitening


def expected(vectors, k=32):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    c = (x - s // n) - (s - n * (s // n)) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    return n, [sum(int(t) ** 2 for t in n * r - s) for r in x], e[::-1][:k], v[:, ::-1][:, :k], c, (c**2).sum() / n


def compare(df, ids, vectors, k=32, tolerance=1e-7):
    n, deviation, e, v, c, trace = expected(vectors, k)
    k = len(e)
    rows = sorted(df.collect(), key=lambda r: (r["vec_id"], r["component"]))
    assert [(r["vec_id"], r["component"]) for r in rows] == [(i, j) for i in sorted(ids) for j in range(1, k + 1)]
    order = np.argsort(ids, kind="stable")
    assert [r["deviation"] for r in rows[::k]] == [deviation[i] for i in order] and {r["n"] for r in rows} == {n}
    got = np.array([r["whitened"] for r in rows]).reshape(-1, k)
    want = (c @ v / np.sqrt(e))[order]
    sign = np.sign((got * want).sum(0))
    assert np.abs(got - want * sign).max() < tolerance
    assert np.abs(np.array([r["explained"] for r in rows[:k]]) / (e / trace) - 1).max() < 1e-9
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9


def test_whitening_of_odd_rows(spark):
    r = np.random.default_rng(1)
    good = (r.standard_normal((300, 40)) * np.linspace(3, 0.5, 40)).tolist()
    odd = [None, [], [1.0] * 39, [float("nan")] + [0.0] * 39, [float("inf")] + [0.0] * 39, [None] + [1.0] * 39]
    rows = [(i, v, 5, "x") for i, v in enumerate([*good, *odd])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int, other string").repartition(3)
    out = whitening.whiten(df)
    assert out.columns == ["vec_id", "other", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(out, list(range(300)), good)


def test_few_dimensions_and_repeats(spark):
    r = np.random.default_rng(2)
    good = [*r.standard_normal((50, 3)).tolist()] * 2
    df = spark.createDataFrame(list(enumerate(good)), "vec_id long, embedding array<float>")
    compare(whitening.whiten(df), list(range(100)), np.array(good, np.float32))


def test_nothing_to_scale(spark):
    kind = "vec_id long, embedding array<double>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)]):
        out = whitening.whiten(spark.createDataFrame(rows, kind))
        assert out.collect() == [] and out.columns[-1] == "identity_error"
    # one constant dimension and one that repeats another: one component is left
    out = whitening.whiten(spark.createDataFrame([(i, [1.0, float(i), float(i)]) for i in range(9)], kind)).collect()
    assert {r["component"] for r in out} == {1} and abs(out[0]["explained"] - 1) < 1e-12


def test_great_entries_stay_exact(spark):
    rows = [(i, [float(3**i) * 1e6, -1e300 if i == 5 else 2.0]) for i in range(12)]
    out = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = [[min(max(int(np.floor(64 * c)), -(2**62)), 2**62) for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    want = [sum((12 * a - b) ** 2 for a, b in zip(v, s, strict=True)) for v in x]
    assert out == {i: w if w < 1 << 63 else None for i, w in enumerate(want)}


@pytest.mark.parametrize(("dims", "wanted", "kind"), [(64, 32, ""), (300, 32, ""), (200, 5, "steep"), (64, 32, "rank"), (500, 32, "decay"), (1, 1, ""), (40, 32, "tie")])
def test_jacobi_davidson(dims, wanted, kind):
    r = np.random.default_rng(dims)
    x = r.standard_normal((1000, dims))
    x = {"": x, "steep": x * np.logspace(0, -6, dims), "rank": x[:, :20] @ r.standard_normal((min(20, dims), dims)), "decay": x * np.exp(-np.arange(dims) / 20), "tie": np.vstack([np.eye(dims), -np.eye(dims)]) if kind == "tie" else x}[kind]
    v = np.cov(x.T, bias=True).reshape(dims, dims)
    e, q = whitening.jacobi_davidson(lambda y: v @ y, dims, wanted)
    assert np.abs(e - np.linalg.eigvalsh(v)[::-1][:wanted]).max() < 1e-13 * e[0] * 10
    assert np.linalg.norm(v @ q - q * e, axis=0).max() < 1e-13 * e[0] and np.abs(q.T @ q - np.eye(wanted)).max() < 1e-13


def test_minres():
    r = np.random.default_rng(3)
    a = r.standard_normal((30, 30))
    a = a + a.T
    b = r.standard_normal((30, 4))
    x = whitening.minres(lambda y: a @ y, b, 60)
    assert np.abs(a @ x - b).max() < 1e-8
    few = [np.linalg.norm(b - a @ whitening.minres(lambda y: a @ y, b, k), axis=0) for k in range(8)]
    assert all((later <= before * (1 + 1e-9)).all() for before, later in zip(few, few[1:], strict=False))


def test_query(spark):
    import pandas as pd

    table = pd.read_parquet("/root/testdata/sf0.001/embeddings.parquet")
    compare(whitening.op11_embedding_whitening(spark, "/root/testdata/sf0.001"), list(table.vec_id), np.stack(table.embedding), tolerance=1e-6)
