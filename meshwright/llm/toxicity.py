"""Toxicity: a counterfactually regularised logistic classifier over words.

A text's features are log(1 + count) of its words (runs of ASCII letters and digits and of characters beyond ASCII,
lower case). The classifier is fitted in numpy on a bounded sample of labelled rows, at most about ``ROWS_A_CLASS`` of
either label, taken by a hash of the id. Weights pay an absolute penalty that falls with the root of the rarer label's
rows and grows with the logarithm of the words, so few words without a bearing on the label stay, at any size.

Beside the usual loss the fit pays for every score change that an identity term makes: each labelled text with such a
term is held against itself with the term swapped for its counterparts and without it, and every labelled text against
itself with a term put in (the terms take turns), so that naming a group by itself moves no score.

Scoring is a look-up of word hashes in the model's sorted words, over whole texts of any length. Null and empty texts
get the score of a text without words. Repeated rows get equal scores. Repeated label rows count as often as they come;
null labels don't count. Equal texts with both labels pull both ways. With no label of one kind the score is the share of
toxic labels (0.5 without labels). An empty table gives an empty result; columns named as an output column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import ALNUM, Words, map_text
from .langid import crc_rest

ROWS_A_CLASS = 4000
#: Words of fewer labelled texts tell nothing.
LEAST_TEXTS = 3
#: Groups whose terms stand for one another (fixed values).
IDENTITY = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["female", "male"], ["black", "white", "asian", "latino"],
    ["muslim", "christian", "jewish", "hindu", "atheist"], ["muslims", "christians", "jews", "hindus", "atheists"],
    ["gay", "straight", "lesbian", "bisexual"], ["transgender", "cisgender"], ["immigrants", "natives"], ["disabled", "abled"],
    ["old", "young"], ["african", "european", "american", "mexican", "chinese"], ["deaf", "hearing"], ["blind", "sighted"],
]


def word_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, word hash and count, for each text's distinct words."""
    w = Words(texts, ALNUM)
    h, doc = w.hashes(), w.texts_of()
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


class Model:
    def __init__(self, words: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(words)
        self.words, self.weights, self.bias = words[order], weights[order], float(bias)
        self.table = np.zeros(1 << 18, bool)
        self.table[self.words >> np.uint64(46)] = True

    def score(self, texts: pa.Array) -> np.ndarray:
        w = Words(texts, ALNUM)
        h, n = w.hashes(), len(w.ptr) - 1
        at = np.flatnonzero(self.table[h >> np.uint64(46)])
        k = np.minimum(np.searchsorted(self.words, h[at]), max(0, len(self.words) - 1))
        if len(self.words):
            at, k = at[self.words[k] == h[at]], k[self.words[k] == h[at]]
        doc = np.searchsorted(w.ptr, at, "right") - 1
        keys, counts = np.unique(doc * max(1, len(self.words)) + k, return_counts=True)
        total = np.bincount(keys // max(1, len(self.words)), np.log1p(counts) * self.weights[keys % max(1, len(self.words))], n) if len(keys) else np.zeros(n)
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -60, 60)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], sparsity: float = 0.002, ridge: float = 1e-5, fairness: float = 5.0, rounds: int = 800) -> Model:
    """rows: label, word hashes and counts of a text. Accelerated proximal steps on loss, penalties and counterfactuals."""
    y = np.array([r[0] for r in rows], float)
    if not len(y) or y.min() == y.max():
        share = y.mean() if len(y) else 0.5
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.log((share + 1e-3) / (1 - share + 1e-3)))
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[1]) for r in rows])
    words, where = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
    value = np.log1p(np.concatenate([r[2] for r in rows]).astype(np.float32))
    groups = [[Words(pa.array([t]), ALNUM).hashes()[0] for t in group] for group in IDENTITY]
    terms = np.unique(np.array([h for g in groups for h in g], np.uint64))
    stays = np.flatnonzero((np.bincount(where, minlength=len(words)) >= LEAST_TEXTS) | np.isin(words, terms))
    own = np.union1d(words[stays], terms)
    renumber = np.full(len(words), -1, np.int32)
    renumber[stays] = np.searchsorted(own, words[stays])
    k = renumber[where]
    doc, k, value = doc[k >= 0], k[k >= 0], value[k >= 0]
    # counterfactuals: how much of term i a text has, and which term stands in for it (-1: none)
    every = np.searchsorted(own, terms)
    pairs = [(np.arange(len(y)), every[np.arange(len(y)) % len(every)], np.full(len(y), -1), np.full(len(y), np.log(2.0)))]
    for g in groups:
        at = np.searchsorted(own, np.array(g, np.uint64)).tolist()
        for i in at:
            has = np.flatnonzero(k == i)
            for j in [x for x in at if x != i] + [-1]:
                pairs.append((doc[has], np.full(len(has), i), np.full(len(has), j), value[has]))
    _, pi, pj, pv = (np.concatenate(x) for x in zip(*pairs, strict=True))
    n, m = len(own), len(pi)
    prior = np.log(y.mean() / (1 - y.mean()))
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5
    weight /= weight.sum()
    rarer = min(y.sum(), (1 - y).sum())
    penalty = sparsity * np.sqrt(np.log(max(n, 2)) / rarer)

    def moved(w):
        return pv * (w[pi] - np.where(pj >= 0, w[pj], 0.0))

    def slope(w, bias):
        f = np.bincount(doc, value * w[k], len(y)) + bias
        g = (1 / (1 + np.exp(-np.clip(f, -60, 60))) - y) * weight
        push = 2 * fairness * moved(w) * pv / m
        return np.bincount(k, value * g[doc], n) + ridge * w + np.bincount(pi, push, n) - np.bincount(pj[pj >= 0], push[pj >= 0], n), g.sum()

    # the steepest curvature, by power iteration, bounds the step
    v = np.ones(n) / np.sqrt(n)
    for _ in range(30):
        u = np.bincount(k, value * (0.25 * weight * np.bincount(doc, value * v[k], len(y)))[doc], n)
        push = 2 * fairness * moved(v) * pv / m
        u += np.bincount(pi, push, n) - np.bincount(pj[pj >= 0], push[pj >= 0], n) + ridge * v
        steep = np.linalg.norm(u)
        v = u / max(steep, 1e-12)
    step = 1 / (1.1 * steep + 0.3)
    w, bias = np.zeros(n), prior
    ahead, ahead_bias, t = w, bias, 1.0
    for _ in range(rounds):
        g, gb = slope(ahead, ahead_bias)
        new = ahead - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_bias = ahead_bias - step * gb
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_bias = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    held = w != 0
    return Model(own[held], w[held], bias)


def cross_validated(rows: list[tuple[int, np.ndarray, np.ndarray]], texts: pa.Array, sparsities: list[float], folds: int = 3) -> dict[float, float]:
    """Mean log loss of each penalty over texts left out of its fits; ``rows`` as in ``fit``, of learning rows alone."""
    y, fold, out = np.array([r[0] for r in rows]), np.arange(len(rows)) % folds, {}
    for s in sparsities:
        loss = 0.0
        for f in range(folds):
            own = np.flatnonzero(fold == f)
            p = np.clip(fit([rows[i] for i in np.flatnonzero(fold != f)], sparsity=s).score(texts.take(pa.array(own))), 1e-6, 1 - 1e-6)
            loss -= (y[own] * np.log(p) + (1 - y[own]) * np.log(1 - p)).sum()
        out[s] = loss / len(rows)
    return out


def learned(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = ROWS_A_CLASS) -> Model:
    """Fit on the labels of at most about ``rows`` rows of either label."""
    labels = labels.select(key, F.col(label).cast("int").alias("_label")).where("_label IN (0, 1)")
    counts = {r["_label"]: r["n"] for r in labels.groupBy("_label").agg(F.count("*").alias("n")).collect()}  # two rows
    share = F.when(F.col("_label") == 1, min(1.0, rows / counts.get(1, 1))).otherwise(min(1.0, rows / counts.get(0, 1)))
    picked = labels.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1 << 20)) < share * (1 << 20))
    found = docs.select(key, text).join(F.broadcast(picked), key)  # bounded by 2 * rows

    def make():
        def do(texts):
            doc, h, n = word_counts(texts)
            at = np.searchsorted(doc, np.arange(len(texts) + 1))
            return {"words": [h[a:b].view(np.int64) for a, b in zip(at[:-1], at[1:], strict=True)], "counts": [n[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]}

        return do

    got = map_text(found, make, "words array<bigint>, counts array<bigint>", text, [key, "_label"]).toArrow()  # flat arrays: no Python object a word
    labels_, keys = got["_label"].to_pylist(), got[key].to_pylist()
    words, counts = (got[c].combine_chunks() for c in ("words", "counts"))
    if not len(got):
        return fit([])
    at, flat, times = words.offsets.to_numpy(), words.values.to_numpy().view(np.uint64), counts.values.to_numpy()
    order = sorted(range(len(keys)), key=lambda i: (keys[i], labels_[i]))
    return fit([(labels_[i], flat[at[i] : at[i + 1]], times[at[i] : at[i + 1]]) for i in order])


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` with score and predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # words of the bounded sample
    out = map_text(docs, lambda: lambda texts: {"score": held.value.score(texts)}, "score double", text, keep)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learned(docs, labels.where(crc_rest(F.col("doc_id"), 5) != 0))
    held_out = F.coalesce(crc_rest(F.col("doc_id"), 5) == 0, F.lit(False))
    return score_toxicity(docs, model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", "predicted")
