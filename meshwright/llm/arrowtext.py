"""Words of whole texts, found with numpy on Arrow's own buffers.

``map_text`` runs a function over a text column in slices of about half a megabyte, so memory stays bounded
whatever the size of the table; a single longer text is a slice of its own. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

SLICE_BYTES = 1 << 19

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that end at ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[32, *range(9, 14)]] = False
#: Bytes of words made of ASCII letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _powers[int(base)] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts on end, and where each begins (one more entry than texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, at, data = texts.buffers()
    if at is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(at, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


class Words:
    """Words of a slice of texts: bytes ``raw[start[i]:end[i]]``; text ``d`` has words ``ptr[d]:ptr[d + 1]``."""

    def __init__(self, texts: pa.Array, kind: np.ndarray):
        self.raw, self.at = buffers(texts)
        inside = kind[self.raw]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        if len(inside):
            heads = self.at[:-1][self.at[:-1] < self.at[1:]]
            first[heads] = inside[heads]
            tails = self.at[1:][self.at[:-1] < self.at[1:]] - 1
            last[tails] = inside[tails]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.ptr = np.searchsorted(self.start, self.at)
        self._low: np.ndarray | None = None

    @property
    def low(self) -> np.ndarray:
        if self._low is None:
            self._low = LOWER[self.raw]
        return self._low

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of each word, by default in lower case."""
        n = len(self.raw)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[self.low if lower else self.raw] * powers(_BASE, n), out=total[1:])
        return mix((total[self.end] - total[self.start]) * powers(_INVERSE, n)[self.start] if n else total[:0])

    def texts_of(self) -> np.ndarray:
        """For each word, the number of its text."""
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))

    def word(self, i: int) -> bytes:
        return self.low[self.start[i] : self.end[i]].tobytes()


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word hashes; no heed to where texts end."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    step = powers(np.uint64(0xD1342543DE82EF95), n)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        out += words[j : len(words) - n + 1 + j] * step[j]
    return mix(out)


def bounds(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that hold at most ``limit`` bytes of text, or one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    row, n = 0, len(size)
    while row < n:
        stop = max(row + 1, int(np.searchsorted(size, (size[row - 1] if row else 0) + limit, "right")))
        yield row, stop
        row = stop


def release() -> None:
    """Hand freed memory back: a worker outlives its tasks, and what it keeps counts against its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def small_batches(df: DataFrame, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch: a batch of texts must fit beside the JVM."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def shielded(docs: DataFrame, *own: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Columns but ``own`` under names that no operator gives, and a function that puts all columns back."""
    plain = {c: c if c in own else f"_in{i}" for i, c in enumerate(docs.columns)}
    kinds = {c: f.dataType for c, f in zip(docs.columns, docs.schema.fields, strict=True)}
    return docs.select(*(F.col(f"`{c}`").alias(a) for c, a in plain.items())), lambda out: out.select(*(F.col(f"`{a}`").cast(kinds[c]).alias(c) for c, a in plain.items()))


def map_text(
    df: DataFrame,
    make: Callable[[], Callable],
    fields: str,
    text: str = "text",
    keep: list[str] | None = None,
    also: tuple[str, ...] = (),
) -> DataFrame:
    """``keep`` (all columns by default) and ``fields`` (DDL), computed from whole texts.

    ``make()`` runs once in each task and gives a function from a slice of texts (and of the columns ``also``)
    to a dict of values by field. It may give ``"_keep"``: which rows stay. A kept column named as a field gives way
    to the field; the text column gives way too where ``fields`` names it.
    """
    from pyspark.sql.types import _parse_datatype_string

    out_fields: StructType = _parse_datatype_string(fields)
    names = out_fields.fieldNames()
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    inner = {c: f"_c{i}" for i, c in enumerate(dict.fromkeys([*keep, *also]))}
    source = df.select(F.col(f"`{text}`").cast("string").alias("_text"), *(F.col(f"`{c}`").alias(a) for c, a in inner.items()))
    schema = StructType([*(StructField(c, source.schema[inner[c]].dataType) for c in keep), *out_fields])
    small_batches(df)

    arrow = to_arrow_schema(schema)

    def run(batches):
        do = make()
        for batch in batches:
            texts = batch.column(0)
            for a, b in bounds(texts):
                part = batch.slice(a, b - a)
                got = do(part.column(0), *(part.column(part.schema.get_field_index(inner[c])) for c in also))
                stay = got.pop("_keep", None)
                cols = [part.column(part.schema.get_field_index(inner[c])) for c in keep]
                cols += [v if isinstance(v := got[n], pa.Array) else pa.array(v, arrow.field(n).type, from_pandas=False) for n in names]
                out = pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(cols, arrow, strict=True)], schema=arrow)
                yield out if stay is None else out.filter(pa.array(np.asarray(stay, bool)))
                out = cols = part = got = None
        do = None
        release()

    return source.mapInArrow(run, schema)
