"""Best-fit packing by minimum bin slack.

A document's tokens are cut into pieces of the capacity; only documents longer than it are cut. How many pieces there
are of each length is all that the plan needs, at most one number a length, so the plan is made on the driver whatever
the size of the table: the longest length left opens a bin, a bitset subset-sum over the lengths left finds the
combination that fills it best, and the combination is taken as often as its lengths last (while they do it stays the
fullest). Each time some length falls below its share of a combination, so there are few combinations. Pieces then get
their rank among those of their length, by salted windows, and look their place up in the plan.

Null and empty texts are the end id alone. Repeated rows are packed as often as they come. An empty table gives no rows.
Long texts are read whole. Pieces of equal length, id and checksum take their places in any order. Columns of the input named as
an output column are replaced.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import map_text
from .storage import saved
from .subwords import Encoder, tokenizer_path

CAPACITY = 4096
END_ID = 1
#: Rows that a window of one length and salt holds, about.
WINDOW_ROWS = 100_000
LEAST_SALTS = 64


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """A row a piece: ``keep``, piece, start, length, ids_crc32."""

    def make():
        encoder = Encoder(path)

        def do(texts):
            ids, at = encoder.encode(texts)
            sizes, sums = [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                cuts = range(0, len(own), capacity)
                sizes.append([min(capacity, len(own) - i) for i in cuts])
                sums.append([zlib.crc32(own[i : i + capacity]) for i in cuts])
            return {"_size": sizes, "_sum": sums}

        return do

    keep = list(docs.columns if keep is None else keep)
    rows = map_text(docs, make, "_size array<bigint>, _sum array<bigint>", text, keep)
    rows = rows.select(*(f"`{c}`" for c in keep if c not in ("piece", "start", "length", "ids_crc32")), F.posexplode(F.arrays_zip("_size", "_sum")).alias("piece", "_one"))
    return rows.withColumns({"start": F.col("piece").cast("bigint") * capacity, "length": F.col("_one._size"), "ids_crc32": F.col("_one._sum")}).drop("_one")


def fullest(room: int, lengths: list[int], counts: dict[int, int]) -> list[tuple[int, int]]:
    """Of lengths (descending) and how many there are, a combination of at most ``room`` that is as full as can be."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for size in lengths:
        if size > room:
            continue
        left, k = min(counts[size], room // size), 1
        while left:
            take = min(k, left)
            steps.append((size, take, reach))
            reach |= (reach << size * take) & mask
            left, k = left - take, 2 * k
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for size, take, before in reversed(steps):
        if not before >> at & 1:
            at -= size * take
            out[size] = out.get(size, 0) + take
    return sorted(out.items(), reverse=True)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces of it in a bin, first bin, offset in the bin) for all pieces."""
    counts = {k: v for k, v in counts.items() if v}
    used, rows, bins = dict.fromkeys(counts, 0), [], 0
    lengths = sorted(counts, reverse=True)
    while lengths:
        longest = lengths[0]
        counts[longest] -= 1
        found = dict(fullest(capacity - longest, lengths, counts))
        counts[longest] += 1
        found[longest] = found.get(longest, 0) + 1
        times, at = min(counts[k] // n for k, n in found.items()), 0
        for size, n in sorted(found.items(), reverse=True):
            rows.append((size, used[size], used[size] + n * times, n, bins, at))
            used[size] += n * times
            counts[size] -= n * times
            at += n * size
        bins += times
        if any(not counts[k] for k in found):
            lengths = [k for k in lengths if counts[k]]
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a saved table with a column length) with sequence_id and offset."""
    spark = pieces.sparkSession
    order = [c for c in ("doc_id", "piece", "ids_crc32") if c in pieces.columns]
    total = pieces.count()
    salts = max(LEAST_SALTS, -(-total // WINDOW_ROWS))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    held = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = held.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    rows = plan(counts, capacity) or [(0, 0, 0, 1, 0, 0)]
    places = spark.createDataFrame([tuple(map(int, r)) for r in rows], "length long, _from long, _to long, _each long, _bin long, _at long")
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1)
    ranked = ranked.join(base, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    # the plan has a bounded number of rows for each of at most `capacity` lengths
    stretch = F.sort_array(F.collect_list(F.struct("_from", "_to", "_each", "_bin", "_at"))).alias("_places")
    by_length = places.groupBy("length").agg(stretch)
    placed = ranked.join(F.broadcast(by_length), "length").withColumn("_p", F.expr("filter(_places, x -> _rank >= x._from AND _rank < x._to)[0]"))
    placed = placed.select(*ranked.columns, "_p.*").withColumn("_k", F.col("_rank") - F.col("_from"))
    return placed.select(
        *(f"`{c}`" for c in pieces.columns if c not in ("sequence_id", "offset")),
        (F.col("_bin") + F.floor(F.col("_k") / F.col("_each"))).cast("bigint").alias("sequence_id"),
        (F.col("_at") + F.col("_k") % F.col("_each") * F.col("length")).cast("bigint").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str | None = None, keep: list[str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(saved(pieces_of(docs, path or tokenizer_path(), capacity, keep=keep), "pieces"), capacity)


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    out = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, keep=["doc_id"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
