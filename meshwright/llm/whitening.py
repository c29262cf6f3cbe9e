"""Whitening of embeddings by the leading eigenvectors of their covariance, found by Jacobi-Davidson.

Entries become whole numbers first, so counts, sums and deviations are exact. The covariance is never formed: a job
multiplies it with a few vectors at a time, centred rows by centred rows, and only sums of (dimensions x vectors) numbers
reach the driver. Rayleigh-Ritz in the subspace so far gives approximations; those whose residuals are at double precision,
from the largest eigenvalue on, are locked; for the others a few steps of MINRES solve the correction equation, projected
against what is locked or sought (all corrections share one job a step), and the corrections widen the subspace, which
starts anew from its best Ritz vectors when it gets too large.

Rows whose vector is null or empty or holds null or non-finite entries are dropped, and so are rows of another length than
the most frequent (of equally frequent ones the greater). Entries beyond 2**62 / 64 count as that. Components of an
eigenvalue of rounding size (one constant dimension is enough to have one) can't be scaled and are left out, so equal or
single vectors give no rows; an empty table gives none either. Repeated rows and null ids are rows like others. Equal
eigenvalues share a plane, of which any basis may come. A deviation beyond 64 bits is null. Columns that are kept and named as
a field of the result give way to it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from .arrowtext import release
from .storage import forget, saved

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Ritz vectors beyond the wanted ones, the subspace's limit as a multiple of them, and steps of MINRES a correction.
SPARE, WIDTH, INNER = 8, 3, 4
ROUNDS = 200
#: A residual at double precision, in units of the largest eigenvalue.
TOLERANCE = 64 * np.finfo(float).eps
#: Eigenvalues of rounding size, in units of the trace.
NOTHING = 1e-13
BLOCK_ROWS = 4096
FIELDS = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whole(vectors: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are finite throughout (and of ``dims`` entries), and their entries as floor(64 c); without ``dims`` their lengths."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    fine = (bad[ends] == bad[ends - sizes]) & (sizes > 0)
    if dims is None:
        return fine, sizes[fine]
    fine &= sizes == dims
    kept = values[np.repeat(fine, sizes)].reshape(-1, dims)
    with np.errstate(over="ignore"):
        return fine, np.clip(np.floor(SCALE * kept), -(2.0**62), 2.0**62).astype(np.int64)


@dataclass
class Whitener:
    """n, and per dimension a whole number near the mean with the exact sum of what entries exceed it by; components as columns."""

    n: int
    middle: np.ndarray
    rest: list[int]
    vectors: np.ndarray | None = None
    values: np.ndarray | None = None
    trace: float = 0.0
    identity_error: float = 0.0

    def centred(self, entries: np.ndarray) -> np.ndarray:
        return (entries - self.middle).astype(float) - np.array([r / self.n for r in self.rest])

    def deviations(self, entries: np.ndarray) -> list[int | None] | np.ndarray:
        off = entries - self.middle
        most = self.n * int(np.abs(off).max(initial=0)) + max(map(abs, self.rest), default=0)
        if most * most * off.shape[1] < 1 << 62:
            return ((self.n * off - np.array(self.rest, np.int64)) ** 2).sum(1)
        sums = [sum((self.n * v - r) ** 2 for v, r in zip(row, self.rest, strict=True)) for row in off.tolist()]
        return [s if s < 1 << 63 else None for s in sums]


def _lengths(rows: DataFrame) -> dict[int, int]:
    """How many finite vectors there are of each length."""

    def run(batches):
        for batch in batches:
            _, sizes = whole(batch.column(0))
            size, n = np.unique(sizes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(size, pa.int64()), pa.array(n, pa.int64())], ["size", "n"])

    found = rows.mapInArrow(run, "size bigint, n bigint").groupBy("size").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    return {r["size"]: r["n"] for r in top}


def _blocks(rows: DataFrame, dims: int) -> DataFrame:
    """Entries of some thousand vectors a row, in 4 bytes each where they fit, else in 8."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                _, entries = whole(batch.column(0).slice(at, BLOCK_ROWS), dims)
                if len(entries):
                    kind = np.int32 if np.abs(entries).max() < 1 << 31 else np.int64
                    yield pa.RecordBatch.from_arrays([pa.array([len(entries)], pa.int64()), pa.array([entries.astype(kind).tobytes()], pa.binary())], ["n", "data"])
        release()

    return rows.mapInArrow(run, "n bigint, data binary")


def _each(batches, dims: int):
    for batch in batches:
        for n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield np.frombuffer(data, np.int32 if len(data) == 4 * n * dims else np.int64).reshape(n, dims).astype(np.int64)


def _exact_sums(blocks: DataFrame, dims: int) -> list[int]:
    def run(batches):
        total = [0] * dims
        for x in _each(batches, dims):
            sums = x.sum(0).tolist() if int(np.abs(x).max()) * len(x) < 1 << 62 else [sum(c) for c in x.T.tolist()]
            total = [a + b for a, b in zip(total, sums, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([str(t) for t in total])], ["slot", "value"])

    sums = blocks.mapInArrow(run, "slot int, value string").groupBy("slot").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    got = {r["slot"]: int(r["value"]) for r in sums.collect()}  # a number a dimension
    return [got[i] for i in range(dims)]


def _summed(blocks: DataFrame, dims: int, size: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``size`` numbers that ``of`` gives for a block of entries."""

    def run(batches):
        total = np.zeros(size)
        for x in _each(batches, dims):
            total += of(x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], ["slot", "value"])

    sums = blocks.mapInArrow(run, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value"))
    out = np.zeros(size)
    for slot, value in sums.collect():  # (dimensions x vectors) numbers, however many rows there are
        out[slot] = value
    return out


def minres(apply: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int) -> np.ndarray:
    """For each column of ``right``, the best solution after ``steps`` steps (Paige and Saunders); ``apply`` is symmetric."""
    size = lambda x: np.linalg.norm(x, axis=0)
    over = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b > 0)
    m = right.shape[1]
    out, before, back2, back1 = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    beta = size(right)
    v = over(right, np.broadcast_to(beta, right.shape).copy())
    left, cos1, sin1, cos2, sin2 = beta.copy(), np.ones(m), np.zeros(m), np.ones(m), np.zeros(m)
    floor = 1e-14 * beta
    for _ in range(steps):
        live = beta > floor
        if not live.any():
            break
        w = apply(v) - beta * before * (_ > 0)
        alpha = (v * w).sum(0)
        w = w - alpha * v
        following = size(w)
        rho3, high = sin2 * beta * (_ > 0), cos2 * beta * (_ > 0)
        rho2, low = cos1 * high + sin1 * alpha, cos1 * alpha - sin1 * high
        rho1 = np.hypot(low, following)
        fine = live & (rho1 > 1e-12 * (np.abs(alpha) + beta + following))
        direction = np.where(fine, (v - rho3 * back2 - rho2 * back1) / np.where(fine, rho1, 1), 0)
        cos, sin = over(low, rho1), over(following, rho1)
        out += np.where(fine, cos * left, 0) * direction
        left, cos2, sin2, cos1, sin1 = -sin * left, cos1, sin1, cos, sin
        back2, back1, before = back1, direction, v
        v = over(w, np.broadcast_to(following, w.shape).copy())
        beta = np.where(fine, following, 0)
    return out


def _orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of ``new`` beside ``against``; directions that hardly stand out are dropped."""
    new = new / np.maximum(np.linalg.norm(new, axis=0), 1e-300)
    for _ in range(2):
        for q in against:
            new = new - q @ (q.T @ new)
        u, s, _t = np.linalg.svd(new, full_matrices=False)
        new = u[:, s > 1e-10]
    return new


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues and their vectors of a symmetric operator known by ``product`` alone."""
    random = np.random.default_rng(seed)
    locked, values = np.zeros((dims, 0)), np.zeros(0)
    basis = _orthonormal(random.standard_normal((dims, min(dims, wanted + SPARE))))
    image = product(basis)
    limit, last, stuck = min(dims, WIDTH * (wanted + SPARE)), np.inf, 0
    for _ in range(ROUNDS):
        need = wanted - locked.shape[1]
        theta, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        ritz, moved = basis @ turn, image @ turn
        residual = moved[:, :need] - ritz[:, :need] * theta[:need]
        residual -= locked @ (locked.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        top = max([*values[:1], *np.abs(theta[:1]), 1e-300])
        spread = basis.shape[1] + locked.shape[1] >= dims
        stuck = stuck + 1 if size.max(initial=0) > last / 2 else 0
        last = size.max(initial=0)
        # rounding of the sums themselves ends it too: no direction is left, or three rounds have not helped near the end
        over = spread or stuck >= 3 and last <= 1e3 * TOLERANCE * top
        done = need if over else int(np.argmax(np.append(size, np.inf) > TOLERANCE * top))
        locked, values = np.hstack([locked, ritz[:, :done]]), np.append(values, theta[:done])
        if locked.shape[1] >= wanted:
            break
        basis, image, theta, residual = ritz[:, done:], moved[:, done:], theta[done:], residual[:, done:]
        need = wanted - locked.shape[1]
        sought, shift = np.hstack([locked, basis[:, :need]]), theta[:need]
        clear = lambda x: x - sought @ (sought.T @ x)  # noqa: B023, E731
        fix = minres(lambda x: clear(product(clear(x)) - shift * clear(x)), clear(-residual), INNER)  # noqa: B023
        if limit < dims and basis.shape[1] + need > limit - locked.shape[1]:
            basis, image = basis[:, : need + SPARE], image[:, : need + SPARE]
        fresh = _orthonormal(fix, locked, basis)
        if not fresh.shape[1]:
            fresh = _orthonormal(random.standard_normal((dims, min(SPARE, dims - locked.shape[1] - basis.shape[1]))), locked, basis)
        basis, image = np.hstack([basis, fresh]), np.hstack([image, product(fresh)])
    order = np.argsort(-values, kind="stable")[:wanted]
    vectors = locked[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return values[order], vectors * signs


def fit(docs: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitener | None:
    """The whitener of all finite vectors of the most frequent length; None where there are none."""
    rows = docs.select(F.col(f"`{vector}`").cast("array<double>").alias("_v"))
    found = _lengths(rows)
    if not found:
        return None
    (dims, n), = found.items()
    stored = saved(_blocks(rows, dims), "vectors")
    blocks = stored.persist(StorageLevel.MEMORY_AND_DISK)
    sums = _exact_sums(blocks, dims)
    middle = [round(s / n) for s in sums]
    own = Whitener(n, np.array(middle, np.int64), [s - n * m for s, m in zip(sums, middle, strict=True)])
    own.trace = float(_summed(blocks, dims, 1, lambda x: np.array([(own.centred(x) ** 2).sum()]))[0]) / n

    def product(q: np.ndarray) -> np.ndarray:
        def of(x):
            c = own.centred(x)
            return c.T @ (c @ q)

        return _summed(blocks, dims, q.size, of).reshape(q.shape) / n

    if own.trace > 0:
        values, vectors = jacobi_davidson(product, dims, min(components, dims))
    else:
        values, vectors = np.zeros(0), np.zeros((dims, 0))
    fine = values > NOTHING * own.trace
    own.values, own.vectors = values[fine], vectors[:, fine]
    k = len(own.values)
    if k:
        scaled = own.vectors / np.sqrt(own.values)

        def of(x):
            y = own.centred(x) @ scaled
            return np.append(y.sum(0), y.T @ y)

        told = _summed(blocks, dims, k + k * k, of) / n
        own.identity_error = float(np.abs(told[k:].reshape(k, k) - np.outer(told[:k], told[:k]) - np.eye(k)).max())
    blocks.unpersist()
    forget(stored)
    return own


def whiten(docs: DataFrame, vector: str = "embedding", components: int = COMPONENTS, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns but the vector by default) and component, n, deviation, whitened, explained, identity_error."""
    fields: StructType = _parse_datatype_string(FIELDS)
    keep = [c for c in ([c for c in docs.columns if c != vector] if keep is None else keep) if c not in fields.fieldNames()]
    schema = StructType([*(docs.schema[c] for c in keep), *fields])
    own = fit(docs, vector, components)
    if own is None or not len(own.values):
        return docs.sparkSession.createDataFrame([], schema)
    arrow, k, dims = to_arrow_schema(schema), len(own.values), len(own.middle)
    scaled = own.vectors / np.sqrt(own.values)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS // 4):
                part = batch.slice(at, BLOCK_ROWS // 4)
                fine, entries = whole(part.column(0), dims)
                m = len(entries)
                each = np.repeat(np.flatnonzero(fine), k)
                deviation = pa.array(own.deviations(entries), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                columns = [part.column(i + 1).take(pa.array(each)) for i in range(len(keep))]
                columns += [pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, own.n)), deviation]
                columns += [pa.array((own.centred(entries) @ scaled).ravel()), pa.array(np.tile(own.values / own.trace, m)), pa.array(np.full(m * k, own.identity_error))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, arrow, strict=True)], schema=arrow)
        release()

    return docs.select(F.col(f"`{vector}`").cast("array<double>").alias("_v"), *(F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep))).mapInArrow(run, schema)


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    out = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), keep=["vec_id"])
    return out.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
