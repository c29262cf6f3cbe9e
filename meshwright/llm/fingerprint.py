"""Document fingerprints: context-triggered piecewise hashing.

A hash of the last seven bytes is taken at each byte of a text's UTF-8; where it hits a residue of the block size, a
chunk ends. Each chunk leaves one of 64 characters. A fingerprint is ``block:signature:signature at twice the block``.
The block size is 3 * 2**k, so that a text gives about 64 chunks, and smaller where that gives less than 32. Likeness
compares signatures of equal block size: twice their longest common subsequence over their length together (one less
the edit distance by insertions and deletions), 0 where they share no run of seven characters; signatures of less than
seven characters count in proportion. Equal fingerprints have likeness 1, and equal texts equal fingerprints.

Null texts are empty; the empty text has the fingerprint ``3::``. Signatures have no cap: very long texts have as many
chunks as the block size gives them. Rows that repeat an id follow each other by text; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import _BASE, _BYTES, _INVERSE, map_text, mix, powers, small_batches
from .storage import saved

WINDOW, LEAST, CHUNKS = 7, 3, 64
_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def _signature(total: np.ndarray, ends: np.ndarray, n: int) -> str:
    cuts = np.append(ends, n) if not len(ends) or ends[-1] < n else ends
    starts = np.concatenate([[0], cuts[:-1]])
    h = mix((total[cuts] - total[starts]) * powers(_INVERSE, n + 1)[starts])
    return _LETTERS[(h >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: bytes) -> str:
    n = len(text)
    if not n:
        return f"{LEAST}::"
    data = np.frombuffer(text, np.uint8)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * powers(_BASE, n), out=total[1:])
    first = np.maximum(np.arange(1, n + 1) - WINDOW, 0)
    roll = mix((total[1:] - total[first]) * powers(_INVERSE, n + 1)[first]) >> np.uint64(33)
    k = 0
    while LEAST * CHUNKS << k < n:
        k += 1
    at = np.flatnonzero(roll % np.uint64(LEAST) == 0) + 1
    roll = roll[at - 1] // np.uint64(LEAST)
    while k and np.count_nonzero(roll & np.uint64((1 << k) - 1) == 0) < CHUNKS // 2:
        k -= 1
    ends, twice = (at[roll & np.uint64((1 << j) - 1) == 0] for j in (k, k + 1))
    return f"{LEAST << k}:{_signature(total, ends, n)}:{_signature(total, twice, n)}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    mask = row = (1 << len(a)) - 1
    for c in b:
        same = row & where.get(c, 0)
        row = ((row + same) | (row - same)) & mask
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    short = min(len(a), len(b))
    run = min(WINDOW, short)
    runs = {a[i : i + run] for i in range(len(a) - run + 1)}
    if not any(b[i : i + run] in runs for i in range(len(b) - run + 1)):
        return 0.0
    return 2 * _common(a, b) / (len(a) + len(b)) * min(1.0, short / WINDOW)


def likeness(x: str, y: str) -> float:
    """0 to 1 for two fingerprints, symmetric."""
    if x == y:
        return 1.0
    (p, a, aa), (q, b, bb) = x.split(":"), y.split(":")
    p, q = int(p), int(q)
    if p == q:
        return max(_alike(a, b), _alike(aa, bb))
    if p == 2 * q:
        return _alike(a, bb)
    return _alike(aa, b) if q == 2 * p else 0.0


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) with fingerprint."""
    return map_text(docs, lambda: lambda texts: {"fingerprint": [fingerprint((t.as_py() or "").encode()) for t in texts]}, "fingerprint string", text, keep)


def edited(text: str, following: str) -> str:
    """The last quarter of the text replaced by as much of the next one's beginning."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_FIELDS = "kind int, part int, doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"
_ARROW = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())])
DONE, FIRST, LAST = range(3)


def _against(text: str, mine: str, following: str, next_print: str) -> tuple:
    changed = edited(text, following).encode()
    own = fingerprint(changed)
    return len(text), hashlib.sha256(changed).hexdigest(), mine, own, likeness(mine, own), likeness(mine, next_print)


def _chain(batches):
    """Sorted rows of a partition, each against its next; the first and the last also wait for their neighbours."""
    part, before, rows = TaskContext.get().partitionId(), None, []

    def out():
        columns = list(zip(*rows, strict=True))
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            mine = fingerprint(text.encode())
            if before is None:
                rows.append((FIRST, part, key, None, None, mine, None, None, None, text))
            else:
                rows.append((DONE, part, before[0], *_against(*before[1:], text, mine), None))
            before = (key, text, mine)
            if len(rows) >= 500:
                yield out()
    if before is not None:
        rows.append((LAST, part, before[0], len(before[1]), None, before[2], None, None, None, before[1]))
        yield out()


def _close(batches):
    """A partition's last row against the next partition's first."""
    for batch in batches:
        rows = [(key, *_against(text, mine, following or "", theirs)) for key, text, mine, following, theirs in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)]
        columns = list(zip(*rows, strict=True)) or [()] * 7
        fields = [_ARROW.field(i) for i in range(2, 9)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))


def against_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint, held against its edited text's and the next document's by ascending key.

    Texts move once, to ranges of the key; a range's border rows, two a range, are settled afterwards.
    """
    spark = docs.sparkSession
    small_batches(docs)
    sorted_ = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).repartitionByRange("key").sortWithinPartitions("key", "text")
    chain = saved(sorted_.mapInArrow(_chain, _FIELDS), "chain")
    parts = sorted(r["part"] for r in chain.where(F.col("kind") == FIRST).select("part").collect())  # a number a partition
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    last = chain.where(F.col("kind") == LAST).select("part", "doc_id", "text", "fingerprint")
    first = chain.where(F.col("kind") == FIRST).select(F.col("part").alias("next"), F.col("text").alias("following"), F.col("fingerprint").alias("theirs"))
    border = last.join(F.broadcast(following), "part").join(first, "next").select("doc_id", "text", "fingerprint", "following", "theirs")
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    closed = border.mapInArrow(_close, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return chain.where(F.col("kind") == DONE).select(*columns).union(closed.select(*columns)).withColumnRenamed("doc_id", key)


def op8_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return against_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
