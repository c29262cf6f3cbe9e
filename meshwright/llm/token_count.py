"""Exact token counts of whole texts, huge ones by overlap resynchronisation.

A text of at most ``chunk`` bytes is counted at once. A longer one is cut into chunks that a shuffle deals out, each
followed by ``overlap`` characters of the next. The tokenizer encodes every chunk with offsets. Its parts of a text
(pre-tokens) hang only on what follows their start, and merges never leave a part; so where the end of a part of one
chunk is a start of a part of the next, both encodings agree from there on, and the counts are spliced there. A boundary
is taken only if it lies ``MARGIN`` characters before the end of its chunk, further than any part or special token looks
ahead (a run of white space, or whatever else reaches the end of its chunk, is never taken). Neighbours without a common
boundary are joined, all that fail in a row at once, and encoded anew, until every splice is proven.

Texts of the first kind are cut before single spaces that follow a character other than white space. A part begins there
whatever stands around it, so counts of such segments add up, and a task asks the tokenizer once for each segment that
it meets (64-bit hashes in a table of fixed size). For tokenizers of another kind than byte-level BPE with its usual
parting, none of this is proven, and every text is encoded whole.

Null and empty texts have no bytes and no tokens. Repeated rows and rows of a null id are counted as they come. An empty
table gives no rows. Columns of the input named as a field of the result give way to it.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import _BASE, _BYTES, _INVERSE, bounds, buffers, map_text, mix, powers, release, small_batches
from .storage import forget, saved
from .subwords import tokenizer_path

CHUNK = 1 << 15
OVERLAP = 512
MARGIN = 24
LIMIT = 512
SLOTS = 1 << 20
FIELDS = ("n_bytes", "n_tokens", "over_limit")

#: Bytes after which a space begins a part: ASCII but white space and control characters.
_SOLID = np.zeros(256, bool)
_SOLID[33:127] = True
#: First bytes of two-byte characters none of which is white space.
_LETTER = np.zeros(256, bool)
_LETTER[0xC3:0xE0] = True


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def local_parts(path: str) -> bool:
    """Whether a tokenizer's parts hang only on what follows them, as this module's splices need."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    parting, added = told.get("pre_tokenizer") or {}, told.get("added_tokens") or []
    plain = parting.get("type") == "ByteLevel" and parting.get("use_regex", True) and not parting.get("add_prefix_space")
    merges = (told.get("model") or {}).get("type") == "BPE" and not told["model"].get("dropout")
    names = [x["content"] for x in added]
    short = all(len(x) <= MARGIN - 8 and not any(c.isspace() for c in x) for x in names) and not any(x.get(k) for x in added for k in ("lstrip", "rstrip", "single_word", "normalized"))
    apart = not any(a.endswith(b[:k]) for a in names for b in names for k in range(1, len(b) + (a != b)))  # no two can overlap
    return bool(plain and merges and short and apart and not told.get("normalizer"))


class Segments:
    """Token counts of texts by segments, each asked of the tokenizer once."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.key, self.size = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        raw, at = buffers(texts)
        n = len(raw)
        if not n:
            return np.zeros(len(texts), np.int64)
        cut = np.zeros(n, bool)
        cut[1:] = (raw[1:] == 32) & _SOLID[raw[:-1]]
        cut[2:] |= (raw[2:] == 32) & (raw[1:-1] >= 128) & _LETTER[raw[:-2]]
        cut[at[:-1][at[:-1] < at[1:]]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[raw] * powers(_BASE, n), out=total[1:])
        h = mix((total[end] - total[start]) * powers(_INVERSE, n)[start])
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        size = np.where(self.key[slot] == h, self.size[slot], 0)
        missing = np.flatnonzero(size == 0)
        if len(missing):
            keys, first, which = np.unique(h[missing], return_index=True, return_inverse=True)
            data = raw.tobytes()
            new = [data[a:b].decode("utf-8", "replace") for a, b in zip(start[missing[first]].tolist(), end[missing[first]].tolist(), strict=True)]
            got = np.array([len(e) for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)], np.int32)
            size[missing] = got[which]
            slots = (keys & np.uint64(SLOTS - 1)).astype(np.int64)
            self.key[slots], self.size[slots] = keys, got
        return np.diff(np.concatenate([[0], np.cumsum(size)])[np.searchsorted(start, at)])


class Whole:
    """Token counts of texts encoded whole."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.sizes = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            tokenizer = load(path)
            self.sizes = lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: pa.Array) -> np.ndarray:
        return np.array(self.sizes([t or "" for t in texts.to_pylist()]), np.int64)


def _chunks(huge: DataFrame, text: str, keep: list[str], chunk: int, overlap: int) -> DataFrame:
    """_key, _no, _own and _over (a chunk's text, and what of the next it is read with); chunk 0 carries ``keep`` as _k0, _k1 ..."""

    def make():
        def do(texts):
            out = []
            for t in texts.to_pylist():
                data, at, rows = (t or "").encode(), 0, []
                while at < len(data):
                    stop = at + chunk if len(data) - at > chunk + 4 * overlap else len(data)
                    while stop < len(data) and data[stop] & 0xC0 == 0x80:
                        stop += 1
                    rows.append({"_own": data[at:stop].decode(), "_over": data[stop : stop + 4 * overlap].decode("utf-8", "ignore")[:overlap]})
                    at = stop
                out.append(rows)
            return {"_rows": out}

        return do

    kept = [f"_k{i}" for i in range(len(keep))]
    rows = huge.select(F.monotonically_increasing_id().alias("_key"), F.col(f"`{text}`").alias("_long"), *(F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept, strict=True)))
    rows = map_text(rows, make, "_rows array<struct<_own: string, _over: string>>", "_long", ["_key", *kept])
    rows = rows.select("_key", *kept, F.posexplode("_rows").alias("_no", "_row"))
    return rows.select("_key", "_no", "_row.*", *(F.when(F.col("_no") == 0, F.col(c)).alias(c) for c in kept))


def _encoded(chunks: DataFrame, path: str, overlap: int) -> DataFrame:
    """_key, _first, _last (numbers of the chunks read as one), _n and boundaries of parts in what is shared with neighbours.

    ``_head`` and ``_tail`` list (at, tokens): characters from the start of the shared text, and the tokens before a
    boundary (in ``_head``) or behind it (in ``_tail``).
    """
    boundary = pa.list_(pa.struct([("at", pa.int64()), ("tokens", pa.int64())]))
    schema = pa.schema([("_key", pa.int64()), ("_first", pa.int32()), ("_last", pa.int32()), ("_n", pa.int64()), ("_head", boundary), ("_tail", boundary)])

    def run(batches):
        tokenizer = load(path)
        for batch in batches:
            for a, b in bounds(batch.column("_own")):
                rows = batch.slice(a, b - a).to_pylist()
                out = []
                for r, e in zip(rows, tokenizer.encode_batch([r["_own"] + r["_over"] for r in rows], add_special_tokens=False), strict=True):
                    part, at = np.array(e.word_ids, np.int64), np.array(e.offsets, np.int64).reshape(-1, 2)[:, 0]
                    begins = np.flatnonzero(np.diff(part, prepend=-1))
                    rim, last = len(r["_own"]), len(r["_own"]) + len(r["_over"]) - MARGIN
                    head = begins[at[begins] <= overlap] if r["_first"] else begins[:0]
                    tail = begins[(at[begins] >= rim) & (at[begins] <= last)] if r["_over"] else begins[:0]
                    found = {"_head": [{"at": int(at[i]), "tokens": int(i)} for i in head], "_tail": [{"at": int(at[i]) - rim, "tokens": len(part) - int(i)} for i in tail]}
                    out.append({k: r[k] for k in ("_key", "_first", "_last")} | {"_n": len(part)} | found)
                yield pa.RecordBatch.from_pylist(out, schema)
                rows = out = None
        release()

    small_batches(chunks)
    told = "array<struct<at: bigint, tokens: bigint>>"
    return chunks.select("_key", "_first", "_last", "_own", "_over").mapInArrow(run, f"_key bigint, _first int, _last int, _n bigint, _head {told}, _tail {told}")


def _spliced(encoded: DataFrame) -> DataFrame:
    """``_extra``: a chunk's tokens behind its splice with the next and the next's before it, 0 at a text's end; null: no common boundary."""
    following = encoded.select("_key", (F.col("_first") - 1).alias("_last"), F.map_from_arrays("_head.at", "_head.tokens").alias("_next"))
    common = F.filter("_tail", lambda x: F.map_contains_key("_next", x["at"]))
    extra = F.get(F.transform(common, lambda x: x["tokens"] + F.element_at("_next", x["at"])), F.lit(0))
    both = encoded.join(following, ["_key", "_last"], "left")
    return both.select("_key", "_first", "_last", "_n", F.when(F.col("_next").isNull(), F.lit(0)).otherwise(extra).alias("_extra"))


def _runs(spliced: DataFrame) -> DataFrame:
    """_key, _first, _last of neighbours that must be read as one, as no boundary between them is proven."""
    order = Window.partitionBy("_key").orderBy("_first")
    begins = F.coalesce(F.lag(F.col("_extra").isNotNull()).over(order), F.lit(True))
    rows = spliced.withColumn("_begins", begins).withColumn("_run", F.sum(F.col("_begins").cast("long")).over(order))
    return rows.groupBy("_key", "_run").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.count("*").alias("_of")).where("_of > 1").select("_key", "_first", "_last")


def resynchronised(huge: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``keep``, n_bytes and n_tokens of texts (not empty), each cut into chunks."""
    keep = list(huge.columns if keep is None else keep)
    chunks = saved(_chunks(huge, text, keep, chunk, overlap), "chunks")
    first = chunks.withColumns({"_first": F.col("_no"), "_last": F.col("_no")}).repartition("_key", "_first")
    encoded = saved(_encoded(first, path, overlap), "encoded")
    while True:
        spliced = saved(_spliced(encoded), "spliced")
        if not spliced.where("_extra IS NULL").limit(1).count():
            break
        runs = saved(_runs(spliced), "runs")
        members = runs.select("*", F.explode(F.sequence("_first", "_last")).alias("_no"))
        # a run has to be read as one, however long, since the tokenizer itself parts it nowhere
        joined = chunks.join(members, ["_key", "_no"]).groupBy("_key", "_first", "_last").agg(F.sort_array(F.collect_list(F.struct("_no", "_own", "_over"))).alias("_all"))
        joined = joined.select("_key", "_first", "_last", F.array_join("_all._own", "").alias("_own"), F.element_at("_all._over", -1).alias("_over"))
        others = encoded.join(members.select("_key", F.col("_no").alias("_first")), ["_key", "_first"], "left_anti")
        wider = saved(others.unionByName(_encoded(joined, path, overlap)), "encoded")
        for old in (encoded, spliced, runs):
            forget(old)
        encoded = wider
    counts = spliced.groupBy("_key").agg(F.sum(F.col("_n") - F.col("_extra")).alias("n_tokens"))
    size = chunks.groupBy("_key").agg(F.sum(F.octet_length("_own")).cast("long").alias("n_bytes"))
    heads = chunks.where("_no = 0").drop("_no", "_own", "_over")
    return heads.join(size, "_key").join(counts, "_key").select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "n_bytes", "n_tokens")


def token_counts(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``keep`` (all columns by default), n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of whole texts."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in FIELDS]
    size = F.coalesce(F.octet_length(F.col(f"`{text}`").cast("string")), F.lit(0))
    proven = local_parts(path)

    def make():
        count = Segments(path) if proven else Whole(path)
        return lambda texts: {"n_bytes": np.diff(buffers(texts)[1]), "n_tokens": count(texts)}

    out = map_text(docs.where(size <= chunk) if proven else docs, make, "n_bytes bigint, n_tokens bigint", text, keep)
    if proven:
        out = out.unionByName(resynchronised(docs.where(size > chunk), path, text, keep, chunk, overlap))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op12_token_counts(spark, sf_dir: str) -> DataFrame:
    out = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("byte_bpe_50k.json"), keep=["doc_id"])
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")
