"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned for in every training text.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. An item's windows are
its runs of ``n`` consecutive words; an item with fewer words, but some, is one window. Window hashes of a text are
looked up in a bit table, then in the sorted hashes, and a hit counts once its words are compared.

The windows of a block of items are broadcast as flat arrays (some 30 bytes a window): a block holds about ``BLOCK_BYTES`` of
text, and a larger benchmark takes several blocks, one after the other over the same rows, whose results are written in between
so that one block is held at a time. So results are whole at any size of the benchmark and no text is shuffled.

Null and empty texts have no words, aren't hit and not contaminated; texts of any length are read whole; null items are no items;
repeated items count once for each id; an empty benchmark hits nothing, an empty table gives an empty result. Columns of the input
named as an output column are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import ALNUM, Words, map_text, mix, powers, shielded
from .storage import saved

N = 13
BLOCK_BYTES = 8 << 20
_STEP, _CHECK = np.uint64(0xD1342543DE82EF95), np.uint64(0x9FB21C651E98DF25)


class Windows:
    """The windows of a block's items by their length: sorted hashes, then where each begins among the items' words."""

    def __init__(self, texts: list[tuple[str, str]], n: int = N):
        import pyarrow as pa

        self.names = sorted({i for i, _ in texts})
        number = {name: k for k, name in enumerate(self.names)}
        self.words = w = Words(pa.array([t for _, t in texts], pa.string()), ALNUM)
        item = np.array([number[i] for i, _ in texts], np.int32)
        h, size, of = w.hashes(), np.diff(w.ptr), w.texts_of()
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        for k in sorted(set(np.minimum(size, n).tolist()) - {0}):
            at = np.flatnonzero((np.minimum(size, n)[of] == k) & (np.arange(len(h)) + k <= w.ptr[of + 1]))
            key, second = (mix(sum(h[at + j] * p for j, p in enumerate(powers(s, k)))) for s in (_STEP, _CHECK))
            order = np.lexsort((item[of[at]], second, key))
            key, second, at, own = key[order], second[order], at[order].astype(np.int32), item[of[at]][order]
            new = np.append(True, (key[1:] != key[:-1]) | (second[1:] != second[:-1]) | (own[1:] != own[:-1]))  # an item once
            key, second, at, own = key[new], second[new], at[new], own[new]
            table = np.zeros(1 << 20, bool)
            table[key >> np.uint64(44)] = True
            self.by_length[k] = (table, key, second, at, own)

    def items(self, k: int, key: int, words: bytes) -> list[str]:
        """Items that hold these words, of a window whose hash is ``key``."""
        _, keys, second, at, own = self.by_length[k]
        a, b = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
        out: list[str] = []
        heads = a + np.flatnonzero(np.append(True, second[a + 1 : b] != second[a : b - 1]))  # windows of one check are one
        for i, j in zip(heads.tolist(), [*heads[1:].tolist(), int(b)], strict=True):
            if b" ".join(self.words.word(int(at[i]) + x) for x in range(k)) == words:
                out += [self.names[x] for x in own[i:j]]
        return out


def _scan(block: Windows, cut: bool):
    """A task's function over a slice: n_words, hit runs (word numbers) and items, added to those of earlier blocks."""
    known: dict[tuple[int, int, bytes], list[str]] = {}

    def do(texts, runs=None, items=None):
        w = Words(texts, ALNUM)
        h, n, docs = w.hashes(), len(w.start), len(w.ptr) - 1
        runs_of = [list(x) for x in runs.to_pylist()] if runs is not None else [[] for _ in range(docs)]
        items_of = [set(x) for x in items.to_pylist()] if items is not None else [set() for _ in range(docs)]
        total = np.zeros(n, np.uint64)
        most = max(block.by_length, default=0)
        step = powers(_STEP, most or 1)
        for k in range(1, most + 1):
            if n < k:
                break
            total = total[: n - k + 1]
            total += h[k - 1 :] * step[k - 1]
            if k not in block.by_length:
                continue
            table, keys = block.by_length[k][:2]
            mixed = mix(total)
            at = np.flatnonzero(table[mixed >> np.uint64(44)])
            at = at[keys[np.minimum(np.searchsorted(keys, mixed[at]), len(keys) - 1)] == mixed[at]]
            doc = np.searchsorted(w.ptr, at, "right") - 1
            inside = at + k <= w.ptr[doc + 1]
            for i, d in zip(at[inside].tolist(), doc[inside].tolist(), strict=True):
                words = b" ".join(w.word(i + j) for j in range(k))
                if len(known) > 50_000:
                    known.clear()
                found = known.get((k, int(mixed[i]), words))
                if found is None:
                    found = known[k, int(mixed[i]), words] = block.items(k, mixed[i], words)
                if found:
                    items_of[d].update(found)
                    runs_of[d] += [i - int(w.ptr[d]), i - int(w.ptr[d]) + k]
        n_hit = []
        for d, x in enumerate(runs_of):
            if x:
                pairs, merged = sorted(zip(x[::2], x[1::2], strict=True)), []
                for a, b in pairs:
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                runs_of[d] = [y for pair in merged for y in pair]
            n_hit.append(sum(runs_of[d][1::2]) - sum(runs_of[d][::2]))
        out = {"n_words": np.diff(w.ptr), "n_hit": n_hit, "_runs": runs_of, "_items": [sorted(x) for x in items_of]}
        if cut:
            out["_cut"] = [_without(w, d, x) if x else None for d, x in enumerate(runs_of)]
        return out

    return do


def _without(w: Words, d: int, runs: list[int]) -> str:
    """The text without the bytes from a run's first word to its last."""
    at, out = int(w.at[d]), []
    for a, b in zip(runs[::2], runs[1::2], strict=True):
        out.append(w.raw[at : w.start[w.ptr[d] + a]].tobytes())
        at = int(w.end[w.ptr[d] + b - 1])
    return b"".join([*out, w.raw[at : w.at[d + 1]].tobytes()]).decode("utf-8", "replace")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", keep: list[str] | None = None, cut: bool = False, n: int = N) -> DataFrame:
    """``keep`` (all columns by default) with n_words, n_hit, n_items, items_sha256 and contaminated.

    With ``cut``, column ``cut_text`` has the text without its hit spans, null where nothing is hit.
    """
    items = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{item_text}`").cast("string").alias("text")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    keep = list(docs.columns if keep is None else keep)
    fields = "n_words bigint, n_hit bigint, _runs array<int>, _items array<string>" + ", _cut string" * cut
    out, sc = docs, docs.sparkSession.sparkContext
    for k in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        held = sc.broadcast(Windows([(r["item"], r["text"]) for r in mine.toLocalIterator()], n))  # about BLOCK_BYTES of text
        out = map_text(out, lambda held=held, last=k == blocks - 1: _scan(held.value, cut and last), fields if k == blocks - 1 else fields.replace(", _cut string", ""), text, [*dict.fromkeys([*keep, *([text] if k < blocks - 1 else [])])], ("_runs", "_items") if k else ())
        if k < blocks - 1:
            out = saved(out, "hits")
            held.destroy()
    done = {
        "n_items": F.size("_items").cast("bigint"),
        "items_sha256": F.sha2(F.array_join(F.array_sort("_items"), ","), 256),
        "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")),
    } | ({"cut_text": F.col("_cut")} if cut else {})
    return out.withColumns(done).drop("_runs", "_items", "_cut", *([] if text in keep else [text] * (blocks > 1)))


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from the others, hit spans are cut."""
    inner, restored = shielded(docs, "doc_id", "text", "n_chars")
    out = decontaminate(inner, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), cut=True).where("NOT contaminated")
    out = out.withColumn("text", F.coalesce("cut_text", "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("cut_text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")))
    return restored(out)
