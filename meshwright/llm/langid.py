"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the runs of 2 to 4 bytes of a word in lower case, its edges marked; each has one of ``BUCKETS`` embeddings.
A text is the average of its subwords' embeddings; a linear layer and a softmax give languages their probabilities.
The model is fitted by stochastic gradient descent in numpy on a bounded sample of labelled rows: about
``ROWS_A_LANGUAGE`` of each language, taken by a hash of the row's id. A fifth of the sample isn't trained on: it sets
the temperature of the softmax and the probability under which a text is rejected.

Since the layer is linear, embeddings and layer fold into one table of a row a bucket, so a text of any length is
scored whole by table look-ups. Null texts and texts without a letter are ``und`` with score 0, and rejected. Repeated
rows get equal results. Without a labelled row everything is ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import ALNUM, LOWER, buffers, map_text, shielded

BUCKETS = 1 << 15
ROWS_A_LANGUAGE = 400
SIZE = 16
#: Of correctly predicted calibration rows, the share that the threshold may reject.
REJECTED = 0.002
#: The digits' bytes aren't letters here.
_LETTER = ALNUM.copy()
_LETTER[48:58] = False
_NORM = np.where(_LETTER, LOWER, 32).astype(np.uint8)


def crc_rest(key: Column, n: int) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n))


def subwords(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """For each of three lengths the bucket of the run at each byte (BUCKETS: none), and where texts begin."""
    raw, at = buffers(texts)
    b = np.concatenate([_NORM[raw], np.full(3, 32, np.uint8)]).astype(np.uint32)
    n, gap = len(raw), b == 32
    left = np.repeat(at[1:], np.diff(at)) - np.arange(n)  # bytes to the end of the text
    h2 = b[:n] * np.uint32(0x9E3779B1) + b[1 : n + 1] * np.uint32(0x85EBCA77)
    h3 = h2 + b[2 : n + 2] * np.uint32(0xC2B2AE3D)
    h4 = h3 + b[3 : n + 3] * np.uint32(0x27D4EB2F)
    out = []
    bad = gap[:n] & gap[1 : n + 1]
    for size, h in ((2, h2), (3, h3), (4, h4)):
        if size > 2:
            bad = (bad if size > 3 else np.zeros(n, bool)) | gap[size - 2 : n + size - 2]
        h = h ^ (h >> np.uint32(15))
        h = (h * np.uint32(0x2C1B3C6D + 2 * size)) >> np.uint32(32 - 15)
        out.append(np.where(bad | (left < size), BUCKETS, h).astype(np.int32))
    return out, at


def has_letter(texts: pa.Array) -> np.ndarray:
    raw, at = buffers(texts)
    count = lambda x: np.concatenate([[0], np.cumsum(x)])[at]
    ascii_letter = ((raw | 32) >= 97) & ((raw | 32) <= 122)
    out = np.diff(count(ascii_letter)) > 0
    for d in np.flatnonzero(~out & (np.diff(count(raw > 127)) > 0)):
        out[d] = any(c.isalpha() for c in texts[int(d)].as_py())
    return out


class Model:
    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, heat: float, least: float):
        self.langs, self.table, self.bias, self.heat, self.least = langs, table, bias, heat, least

    def logits(self, texts: pa.Array) -> np.ndarray:
        grams, at = subwords(texts)
        total = np.zeros((len(at) - 1, len(self.langs) + 1))
        full = np.flatnonzero(np.diff(at))
        for g in grams if len(full) else ():
            total[full] += np.add.reduceat(self.table[g], at[:-1][full], axis=0, dtype=np.float64)
        return total[:, :-1] / np.maximum(total[:, -1:], 1) + self.bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 6, rate: float = 20.0, seed: int = 7) -> Model:
    """rows: language, buckets and how often each occurs in the text."""
    langs = sorted({r[0] for r in rows})
    number = {x: i for i, x in enumerate(langs)}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    apart, learn = order[: len(rows) // 5], order[len(rows) // 5 :]
    table = rng.normal(0, 0.1, (BUCKETS + 1, SIZE)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (SIZE, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    steps, done = max(1, epochs * len(learn)), 0
    for _ in range(epochs):
        for r in rng.permutation(learn):
            lang, ids, counts = rows[r]
            share = (counts / max(1, counts.sum())).astype(np.float32)
            x = share @ table[ids]
            grad = softmax(x @ layer + bias)
            grad[number[lang]] -= 1
            now = rate * (1 - done / steps)
            table[ids] -= now * share[:, None] * (layer @ grad)
            layer -= 0.02 * now * np.outer(x, grad)
            bias -= 0.001 * now * grad
            done += 1
    flat = np.concatenate([table @ layer, np.ones((BUCKETS + 1, 1), np.float32)], axis=1).astype(np.float32)
    flat[BUCKETS] = 0
    held = np.array([(rows[r][2] / max(1, rows[r][2].sum())) @ flat[rows[r][1], :-1] + bias for r in apart]).reshape(len(apart), len(langs))
    want = np.array([number[rows[r][0]] for r in apart], int)
    heats = np.geomspace(0.25, 8, 41)
    heat = float(min(heats, key=lambda t: -np.log(softmax(held / t)[np.arange(len(want)), want] + 1e-12).sum())) if len(want) else 1.0
    p = softmax(held / heat)
    right = p.max(1)[p.argmax(1) == want] if len(want) else np.zeros(0)
    least = float(min(0.5, np.quantile(right, REJECTED))) if len(right) else 0.0
    return Model(langs, flat, bias, heat, least)


def learned(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = ROWS_A_LANGUAGE) -> Model | None:
    """Fit on about ``rows`` rows of each language."""
    docs = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[lang]: r["n"] for r in docs.groupBy(lang).agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return None
    share = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, rows / n)))))[F.col(lang)]
    picked = docs.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1 << 20)) < share * (1 << 20))

    def make():
        def do(texts):
            grams, at = subwords(texts)
            ids, counts = [], []
            for a, b in zip(at[:-1], at[1:], strict=True):
                n = np.bincount(np.concatenate([g[a:b] for g in grams]), minlength=BUCKETS + 1)[:BUCKETS]
                ids.append(np.flatnonzero(n).astype(np.int32))
                counts.append(n[ids[-1]].astype(np.int32))
            return {"ids": ids, "counts": counts}

        return do

    got = map_text(picked.select(key, text, lang), make, "ids array<int>, counts array<int>", text, [key, lang]).collect()  # bounded by `rows`
    return fit([(r[lang], np.array(r["ids"]), np.array(r["counts"])) for r in sorted(got, key=lambda r: str(r[key])) if r["ids"]])


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` with lang_pred, score and rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows

    def make():
        m = held.value

        def do(texts):
            letter = has_letter(texts)
            if m is None:
                return {"lang_pred": ["und"] * len(texts), "score": np.zeros(len(texts)), "rejected": [True] * len(texts)}
            p = softmax(m.logits(texts) / m.heat)
            best = p.argmax(1)
            score = np.where(letter, p.max(1), 0.0)
            return {"lang_pred": [m.langs[k] if x else "und" for k, x in zip(best, letter, strict=True)], "score": score, "rejected": ~letter | (score < m.least)}

        return do

    return map_text(docs, make, "lang_pred string, score double, rejected boolean", text, keep)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(crc_rest(F.col("doc_id"), 4) == 2, F.lit(False))
    model = learned(docs.where(~held_out))
    return predict(docs, model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go."""
    model = learned(docs.where(F.coalesce(crc_rest(F.col("doc_id"), 4) != 2, F.lit(True))))
    inner, restored = shielded(docs, "doc_id", "text")
    return restored(predict(inner, model).where("NOT rejected"))
