"""Personal data by a semi-Markov conditional random field over whole candidate spans.

Base spans of four kinds are found by their grammars (`base_spans`). Where digits, ``@`` or a written-out ``at`` are
left that no base span covers, the stretch about them is cut into atoms (runs of letters, runs of digits, single
other characters), and every run of at most ``ATOMS`` atoms is a candidate segment of each kind. A segment's score is
the sum of the weights of its whole-span features (its shape, its digits, its checks, its borders, the word before);
atoms outside segments score 0, so the best split of the text splits at the stretches, and a dynamic programme over
each of them picks boundaries and kinds together. Segments found beside the base spans are added; base spans stay.

The weights maximise the likelihood of labelled stretches: those of a bounded sample of about ``STRETCHES`` documents, taken
by a hash of the id (of a document at most four base spans and four other stretches, by a hash of their place), with the base
spans as labels, and the same with base spans rewritten in forms that the grammars miss: phones without a country code,
addresses with a written-out "at" or "dot", addresses of hosts with parted dots, card numbers parted by dots or slashes.

Null and empty texts have no spans. Of splits that score alike the one with fewer and earlier segments counts. An empty table
gives an empty result, and nothing to learn from leaves the base spans. Columns named as an output column are replaced. Texts of any length are read whole: stretches longer than a window are decoded in
overlapping windows. Repeated rows get equal results; offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import buffers, map_text, shielded

KINDS = ("email", "ip", "card", "phone")
ATOMS, STRETCHES, WINDOW = 24, 600, 240

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]+|[\[({]\x20?at\x20?[\])}]")
_ATOM = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start; each grammar in time linear in the text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(map(_small, four)):
                out.append((1, at, at + size))
            at += size + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def stretches(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Windows about marks that no span covers, at white space; marks at most four characters apart share one."""
    covered = sorted((a, b) for _, a, b in spans)
    groups: list[list[int]] = []
    k = 0
    for m in _MARK.finditer(text):
        while k < len(covered) and covered[k][1] <= m.start():
            k += 1
        if k < len(covered) and covered[k][0] <= m.start() and m.end() <= covered[k][1]:
            continue
        if groups and m.start() - groups[-1][1] <= 4:
            groups[-1][1] = m.end()
        else:
            groups.append([m.start(), m.end()])
    out = []
    for a, b in groups:
        left = max(0, a - 48)
        right = min(len(text), b + 48)
        for at in range(left, right, WINDOW // 2):
            out.append((at, min(right, at + WINDOW)))
            if at + WINDOW >= right:
                break
    return out


def features(text: str, a: int, b: int) -> list[str]:
    """Whole-span features of text[a:b]."""
    s = text[a:b]
    digits = re.sub("[^0-9]", "", s)
    run = re.sub("[0-9]+", lambda m: str(min(9, len(m[0]))) + "#", re.sub("[A-Za-z]+", "A", s))
    short = re.sub("#+", "#", re.sub("[0-9]", "", run))
    n = len(digits)
    parts = s.split(".")
    before = text[a - 1] if a else " "
    after = text[b] if b < len(text) else " "
    kind = lambda c: "s" if c.isspace() else "w" if c.isalnum() else c
    word = re.search(r"([A-Za-z]{1,12})[^A-Za-z0-9]{0,3}$", text[max(0, a - 16) : a])
    at = re.search(r"@|[\[({]\x20?at\x20?[\])}]", s)
    host = s[at.end() :] if at else ""
    return [
        "1", f"digits={n if n < 20 else 20}", f"shape={run[:40]}", f"form={short[:40]}", f"left={kind(before)}", f"right={kind(after)}",
        f"check={9 < n < 20 and luhn(digits) and n > 12}{len(parts) == 4 and all(p.isascii() and p.isdigit() and _small(p) for p in parts)}{s[0] == '+'}",
        f"at={at is not None}{bool(at and at.start())}{bool(re.fullmatch(r'[A-Za-z0-9-]+(?:(?:[.]|[\x20]?[\[({]dot[\])}][\x20]?)[A-Za-z0-9-]+)+', host.strip()))}{' ' in host.strip() and 'dot' not in host}",
        f"outer={kind(before)}{s[0].isalnum() or s[0] in '+('}{s[-1].isalnum()}{kind(after)}", f"word={word[1].lower() if word else ''}", f"atoms={min(12, len(_ATOM.findall(s)))}",
    ]


class Stretch:
    """Atoms of a stretch and its candidate segments (atom a to atom b) with their features."""

    def __init__(self, text: str):
        self.text = text
        self.edges = [m.start() for m in _ATOM.finditer(text)] + [len(text)]
        n = len(self.edges) - 1
        marked = [bool(re.search(r"[0-9@]", text[self.edges[i] : self.edges[i + 1]])) or text[self.edges[i] : self.edges[i + 1]] == "at" for i in range(n)]
        total = np.concatenate([[0], np.cumsum(marked)])
        fine = lambda i: text[self.edges[i]].isalnum()
        self.segments = [(i, j) for i in range(n) if fine(i) or text[self.edges[i]] in "+(" for j in range(i + 1, min(n, i + ATOMS) + 1) if total[j] > total[i] and fine(j - 1)]
        self.features = [features(text, self.edges[i], self.edges[j]) for i, j in self.segments]


def fit(labelled: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = 5, rate: float = 0.3, decay: float = 1e-4, seed: int = 5) -> dict[str, np.ndarray]:
    """Weights by feature (one a kind), by stochastic gradient ascent on the likelihood of the labelled splits."""
    rng = np.random.default_rng(seed)
    names: dict[str, int] = {}
    data = []
    for text, spans in labelled:
        s = Stretch(text)
        if not s.segments:
            continue
        ids = np.array([[names.setdefault(f, len(names)) for f in fs] for fs in s.features])
        at = {(s.edges[i], s.edges[j]): k for k, (i, j) in enumerate(s.segments)}
        gold = np.zeros((len(s.segments), len(KINDS)))
        for kind, a, b in spans:
            if (a, b) in at:
                gold[at[a, b], kind] = 1
        data.append((len(s.edges) - 1, np.array(s.segments), ids, gold))
    if not names:
        return {}  # nothing to learn from: base spans alone
    w = np.zeros((len(names), len(KINDS)))
    w[names.get("1", 0)] = -2.0
    seen = np.full(len(names), 1e-2)
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            n, seg, ids, gold = data[k]
            score = w[ids].sum(1)
            whole = np.logaddexp.reduce(score, axis=1)
            ahead, back = np.zeros(n + 1), np.zeros(n + 1)
            by_end, by_start = defaultdict(list), defaultdict(list)
            for m, (i, j) in enumerate(seg):
                by_end[j].append(m)
                by_start[i].append(m)
            for j in range(1, n + 1):
                ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[seg[m, 0]] + whole[m] for m in by_end[j])])
            for i in range(n - 1, -1, -1):
                back[i] = np.logaddexp.reduce([back[i + 1], *(back[seg[m, 1]] + whole[m] for m in by_start[i])])
            chance = np.exp(ahead[seg[:, 0]] + back[seg[:, 1]] - ahead[n])[:, None] * np.exp(score)
            grad = gold - np.minimum(chance, 1)
            push = grad[:, None, :].repeat(ids.shape[1], 1).reshape(-1, len(KINDS))
            flat = ids.ravel()
            few, where = np.unique(flat, return_inverse=True)
            step = np.zeros((len(few), len(KINDS)))
            np.add.at(step, where, push)
            seen[few] += (step**2).sum(1)
            w[few] += rate * step / np.sqrt(seen[few])[:, None] - rate * decay * w[few]
    return {f: w[i] for f, i in names.items()}


def decode(text: str, weights: dict[str, np.ndarray], least: float = 1.0) -> list[tuple[int, int, int]]:
    """The best split of a stretch: (kind, start, end); a segment must gain ``least`` over leaving its atoms out."""
    s = Stretch(text)
    n = len(s.edges) - 1
    none = np.zeros(len(KINDS))
    by_end = defaultdict(list)
    for (i, j), fs in zip(s.segments, s.features, strict=True):
        score = sum((weights.get(f, none) for f in fs), none)
        k = int(score.argmax())
        if score[k] > least:
            by_end[j].append((i, float(score[k]), k))
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        best[j], back[j] = best[j - 1], None
        for i, score, k in by_end[j]:
            if best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, (i, k)
    out, j = [], n
    while j:
        if back[j]:
            i, k = back[j]
            out.append((k, s.edges[i], s.edges[j]))
            j = i
        else:
            j -= 1
    return out[::-1]


def forms_of(s: str, kind: int) -> list[str]:
    """A span in forms that the grammars miss."""
    if kind == 3:
        d = re.sub("[^0-9]", "", s)[-10:]
        return [f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}"] if len(d) == 10 else []
    if kind == 0:
        name, _, host = s.partition("@")
        plain = [(name, host), (re.sub("[0-9._%+-]", "", name) or "name", re.sub("[0-9]", "", host)), (re.sub("[0-9]", "", name) or "name", ".".join(host.split(".")[-2:]))]
        return [f for n, h in plain for f in (f"{n} [at] {h}", f"{n} (at) {h}", f"{n}[at]{h}", f"{n} [at] {h.replace('.', ' [dot] ')}", f"{n} (at) {h.replace('.', ' [dot] ')}", f"{n} (at) {h.replace('.', ' (dot) ')}")]
    if kind == 1:
        return [s.replace(".", "[.]"), s.replace(".", " . "), s.replace(".", "(.)")]
    d = re.sub("[^0-9]", "", s)
    return [".".join(d[i : i + 4] for i in range(0, len(d), 4)), "/".join(d[i : i + 4] for i in range(0, len(d), 4))]


def rewritten(text: str, kind: int, a: int, b: int, turn: int = 0, most: int = 3) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The stretch with its span in at most ``most`` other forms, which take turns."""
    forms = forms_of(text[a:b], kind)
    picked = [forms[(turn + i) % len(forms)] for i in range(min(most, len(forms)))]
    return [(text[:a] + f + text[b:], [(kind, a, a + len(f))]) for f in picked]


def marked(texts: pa.Array) -> np.ndarray:
    """Texts that hold a digit, an @ or a bracket: others have nothing to look at."""
    raw, at = buffers(texts)
    hit = (raw >= 48) & (raw <= 57) | (raw == 64) | (raw == 91) | (raw == 40) | (raw == 123)
    return np.diff(np.concatenate([[0], np.cumsum(hit)])[at]) > 0


def learned(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = STRETCHES) -> dict[str, np.ndarray]:
    """Weights from about ``rows`` documents that hold digits or @, base spans as labels."""

    def make():
        def do(texts):
            out = []
            for t, some in zip(texts, marked(texts), strict=True):
                got = []
                if some:
                    t = t.as_py() or ""
                    spans = base_spans(t)
                    mixed = lambda x: sorted(x, key=lambda y: zlib.crc32(repr(y).encode()))[:4]
                    for a, b in [(max(0, p - 48), min(len(t), q + 48)) for _, p, q in mixed(spans)] + mixed(stretches(t, spans)):
                        if b - a <= WINDOW:
                            inside = [(k, p - a, q - a) for k, p, q in spans if a <= p and q <= b]
                            got.append({"text": t[a:b], "spans": [y for x in inside for y in x]})
                out.append(got)
            return {"_found": out}

        return do

    docs = docs.where(F.col(text).rlike("[0-9@]"))
    n = docs.count()
    picked = docs.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1 << 20)) < min(1.0, rows / max(1, n)) * (1 << 20))
    got = map_text(picked.select(key, text), make, "_found array<struct<text:string,spans:array<int>>>", text, [key]).select(key, F.inline("_found")).collect()  # at most 8 windows a picked row
    labelled = []
    for turn, r in enumerate(sorted(got, key=lambda r: (str(r[key]), r["text"]))):
        spans = [tuple(r["spans"][k : k + 3]) for k in range(0, len(r["spans"]), 3)]
        labelled.append((r["text"], spans))
        if len(spans) == 1:
            labelled += rewritten(r["text"], *spans[0], turn)
    return fit(labelled)


def spans_of(text: str, weights: dict[str, np.ndarray]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and base spans with those that the model adds."""
    base = base_spans(text)
    held = sorted((a, b) for _, a, b in base)
    reach = np.maximum.accumulate([b for _, b in held]).tolist() if held else []
    added: list[tuple[int, int, int]] = []
    for a, b in stretches(text, base):
        for k, p, q in decode(text[a:b], weights):
            p, q = p + a, q + a
            cut = p == a and a > 0 or q == b and b < len(text)  # the window's border isn't the span's
            i = bisect_left(held, (p, q))  # spans in hand don't overlap but where base kinds do: neighbours tell
            if not cut and (i == len(held) or q <= held[i][0]) and (not i or p >= reach[i - 1]):
                added.append((k, p, q))
                held.insert(i, (p, q))
                reach.insert(i, max(q, reach[i - 1] if i else 0))
    return base, sorted([*base, *added])


def find_pii(docs: DataFrame, weights: dict[str, np.ndarray], text: str = "text", keep: list[str] | None = None, mask: bool = False) -> DataFrame:
    """``keep`` with _base and _all (arrays of kind:start:end); with ``mask``, masked: the text with spans replaced."""
    held = docs.sparkSession.sparkContext.broadcast(weights)  # features of the bounded sample

    def make():
        def do(texts):
            bases, every, masked = [], [], []
            for t, some in zip(texts, marked(texts), strict=True):
                if not some:
                    bases.append([])
                    every.append([])
                    masked.append(None)
                    continue
                t = t.as_py() or ""
                base, spans = spans_of(t, held.value)
                write = lambda x: [f"{KINDS[k]}:{a}:{b}" for k, a, b in x]
                bases.append(write(base))
                every.append(write(spans))
                if mask:
                    out, at = [], 0
                    for k, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
                        if a >= at:
                            out += [t[at:a], f"<{KINDS[k].upper()}>"]
                        at = max(at, b)
                    masked.append("".join([*out, t[at:]]) if spans else None)
            return {"_base": bases, "_all": every} | ({"masked": masked} if mask else {})

        return do

    return map_text(docs, make, "_base array<string>, _all array<string>" + ", masked string" * mask, text, keep)


def op5_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = find_pii(docs, learned(docs), keep=["doc_id"])
    count = lambda k: F.size(F.filter("_base", lambda s: s.startswith(k + ":"))).cast("bigint").alias(f"n_{k}")
    return out.select("doc_id", *map(count, KINDS), F.sha2(F.array_join("_base", ","), 256).alias("base_sha256"), F.array_join("_all", ",").alias("spans"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans give way to the name of their kind."""
    inner, restored = shielded(docs, "doc_id", "text", "n_chars")
    out = find_pii(inner, learned(docs), mask=True).withColumn("text", F.coalesce("masked", "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("masked").isNotNull(), F.length("text")).otherwise(F.col("n_chars")))
    return restored(out)
