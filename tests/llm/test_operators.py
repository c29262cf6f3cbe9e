"""The training-data operators against brute force on small tables with nulls, empties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from meshwright.llm import decontaminate, fingerprint, langid, license_scan, lm_score, ngram_join, pack, pii, toxicity, url_filter

WORDS = "red green blue one two three four five six seven eight nine ten alpha beta gamma delta sun moon star".split()


def text(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = [text(i, 60) for i in range(6)]
    near = [base[0] + " extra", base[0].replace("red", "Red"), base[1][:-4], " ".join(base[2].split()[:40] + text(99, 30).split())]
    rows = [(i, t, "en" if i % 2 else "de", "s", 5) for i, t in enumerate([*base, *near, None, "", " \n ", "one", "one two", base[3], "!?", "日本語 テスト", "é" * 3000 + " " + text(5, 3000)])]
    rows.append(rows[0])
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string, n_chars int")


def rows_of(df):
    return df.collect()


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_jaccard_join(docs):
    data = [(r["doc_id"], shingles(r["text"])) for r in rows_of(docs)]
    comp = {d: d for d, _ in data}
    for _ in data:
        for a, s in data:
            for b, t in data:
                if s and t and 100 * len(s & t) >= 75 * len(s | t):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = rows_of(ngram_join.near_duplicates(docs))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted((d, len(s), comp[d]) for d, s in data)


def test_dense_groups_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FEW", 2)
    monkeypatch.setattr(ngram_join, "CHUNK", 4)
    r = random.Random(8)
    rows = []
    for g in range(12):
        base = [r.choice(WORDS) + str(r.randrange(30)) for _ in range(80)]
        for _ in range(r.choice([1, 2, 9, 20])):
            t = list(base)
            for _ in range(r.randrange(0, 4)):
                t[r.randrange(80)] = f"x{r.randrange(999)}"
            rows.append((len(rows), "a common line of six words " + " ".join(t)))
    data = [(i, shingles(t)) for i, t in rows]
    comp = {i: i for i, _ in data}
    for _ in range(6):
        for a, x in data:
            for b, y in data:
                if 100 * len(x & y) >= 75 * len(x | y):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = rows_of(ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string")))
    assert {x["doc_id"]: x["component_id"] for x in got} == comp


def test_stage_with_repeated_ids(spark):
    a, b, c = text(0, 60), text(50, 60), text(51, 60)
    rows = [(1, a), (1, a), (2, a + " extra"), (2, b), (3, b + " extra"), (4, c), (4, c + " extra"), (5, ""), (5, None), (None, c)]
    d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id int, text string, _node int")
    out = ngram_join.stage(spark, d, "")
    got = [(r["doc_id"], r["text"]) for r in rows_of(out)]
    assert out.dtypes == d.dtypes and len(got) == 6
    assert got.count((1, a)) == got.count((2, b)) == got.count((5, "")) == got.count((5, None)) == got.count((None, c)) == 1
    assert ((4, c) in got) != ((4, c + " extra") in got)


def test_chunks_of_a_family():
    rng = np.random.default_rng(0)
    base = np.sort(rng.integers(0, 1 << 60, 80, dtype=np.uint64))
    sets = [np.sort(np.concatenate([base[rng.random(80) < 0.95], rng.integers(0, 1 << 60, 3, dtype=np.uint64)])) for _ in range(12)]
    chunk = ngram_join.Chunk(sets)
    for s in [*sets, base]:
        want = [i for i, o in enumerate(sets) if 100 * len(np.intersect1d(s, o)) >= 75 * len(np.union1d(s, o))]
        assert chunk.links(s, np.arange(12)).tolist() == want


def test_decontaminate(spark, docs):
    items = spark.createDataFrame([(1, text(0, 60)), (2, "six SEVEN"), (3, None), (4, "..."), (5, text(0, 60))], "item_id int, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = {}
    for r in rows_of(items):
        w = words(r["text"])
        for i in range(len(w) - min(13, len(w)) + 1) if w else ():
            held.setdefault(tuple(w[i : i + 13]), set()).add(str(r["item_id"]))
    want = []
    for r in rows_of(docs):
        w = words(r["text"])
        hit, found = [0] * len(w), set()
        for k, ids in held.items():
            for i in range(len(w) - len(k) + 1):
                if tuple(w[i : i + len(k)]) == k:
                    found |= ids
                    hit[i : i + len(k)] = [1] * len(k)
        want.append((r["doc_id"], len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    got = decontaminate.decontaminate(docs, items, keep=["doc_id"])
    assert sorted(map(tuple, rows_of(got))) == sorted(want)


def test_benchmark_in_blocks(spark, docs, monkeypatch):
    items = spark.createDataFrame([(i, text(i, 60)) for i in range(4)], "item_id int, text string")
    whole = sorted(map(tuple, rows_of(decontaminate.decontaminate(docs, items, keep=["doc_id"]))))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    assert sorted(map(tuple, rows_of(decontaminate.decontaminate(docs, items, keep=["doc_id"])))) == whole


def test_packing(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(pack.tokenizer_path())
    want = {}
    for r in rows_of(docs):
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        for p in range(0, len(ids), 4096):
            x = np.array(ids[p : p + 4096], "<u4")
            want[r["doc_id"], p // 4096] = (p, len(x), zlib.crc32(x.tobytes()))
    got = rows_of(pack.pack_documents(docs, keep=["doc_id"]))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want) + 1
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096


def test_plan_is_tight():
    rng = np.random.default_rng(3)
    counts = {int(k): int(v) for k, v in zip(*np.unique(rng.integers(1, 4000, 5000), return_counts=True), strict=True)}
    rows = pack.plan(dict(counts))
    assert {k: sum(r[2] - r[1] for r in rows if r[0] == k) for k in counts} == counts
    total = sum(k * v for k, v in counts.items())
    assert max(r[4] + (r[2] - r[1]) // r[3] for r in rows) <= 1.005 * total / 4096


def test_odd_words_encode_as_the_tokenizer_does():
    from meshwright.llm.subwords import Encoder, tokenizer_path

    e = Encoder(tokenizer_path())
    odd = ["it's don't 'tis", "<|endoftext|> a<|endoftext|>b <|ENDOFTEXT|>", "", None, "é». «a» ²3 x² 12ab34", "İstanbul ÉCOLE Straße ÷5", "日本語 テスト。", "\x00\x1fz \x7f a\x1cb \x85", "...!!! a-b_c/d"]
    for _ in range(2):
        ids, at = e.encode(pa.array(odd))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in odd]


def test_fingerprints(docs):
    data = sorted({(r["doc_id"], r["text"] or "") for r in rows_of(docs)} , key=lambda x: x[0])
    got = {r["doc_id"]: r for r in rows_of(fingerprint.against_next(docs.dropDuplicates(["doc_id"])))}
    for i, (d, t) in enumerate(data):
        following = data[(i + 1) % len(data)][1]
        e = fingerprint.edited(t, following)
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r["fingerprint"] == fingerprint.fingerprint(t.encode()) and r["edited_fingerprint"] == fingerprint.fingerprint(e.encode())
        assert 0 <= r["near_edited"] <= 1 and r["near_next"] == fingerprint.likeness(r["fingerprint"], fingerprint.fingerprint(following.encode()))
    assert fingerprint.likeness(*[fingerprint.fingerprint(text(7, 900).encode())] * 2) == 1
    assert fingerprint.likeness(fingerprint.fingerprint(text(7, 900).encode()), fingerprint.fingerprint((text(7, 900) + " tail").encode())) > 0.9


BASE = [
    (0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda s: True), (1, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    (2, r"[0-9](?:[\x20-]?[0-9])+", lambda s: 13 <= len(re.sub("[ -]", "", s)) <= 19 and pii.luhn(re.sub("[ -]", "", s))), (3, r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
]


def test_base_spans_are_the_grammars():
    r = random.Random(1)
    pieces = ["a@b.c", "@", "a.b@c", "x@y@z.w", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.2.3.255", "4111 1111 1111 1111", "+1 (017) 555-7713", "+", "(", ")", ".", " ", "-", "7", "12", "a@b.c@d.e", "é", "4111-1111-1111-1112", "\n"]
    for _ in range(3000):
        t = "".join(r.choice(pieces) for _ in range(r.randint(1, 8)))
        assert pii.base_spans(t) == [(k, m.start(), m.end()) for k, p, ok in BASE for m in re.finditer(p, t) if ok(m[0])], t


def test_long_runs_take_linear_time():
    pii.base_spans("1" * 200_000 + "a" * 200_000 + "@")


def test_pii_table(spark):
    d = spark.createDataFrame([(i, f"{text(i, 5)} m{i}.x@mail{i}.example.com {text(i, 4)} +1 (017) 555-77{i:02d} end") for i in range(30)] + [(90, None), (91, ""), (92, "call (017) 555-7713 now")], "doc_id int, text string")
    out = {r["doc_id"]: r for r in rows_of(pii.find_pii(d, pii.learned(d), keep=["doc_id"], mask=True))}
    assert len(out[3]["_base"]) == 2 and set(out[3]["_base"]) <= set(out[3]["_all"]) and "<EMAIL>" in out[3]["masked"]
    assert out[90]["_all"] == out[91]["_all"] == []


def test_pii_recall_of_other_forms(spark):
    r = random.Random(11)
    names, hosts = ["ann", "bob.lee", "j.doe", "x1", "hein.19"], ["mail.example.com", "site.org", "mail7.example.net", "uni.ac.uk"]

    def card():
        base = f"4{r.randrange(10**14):014d}"
        return next(c for c in (base + str(k) for k in range(10)) if pii.luhn(c))

    def parted(c):
        return " ".join(c[i : i + 4] for i in (0, 4, 8, 12))

    make = [lambda: f"{r.choice(names)}@{r.choice(hosts)}", lambda: ".".join(str(r.randrange(256)) for _ in range(4)), lambda: parted(card()), lambda: f"+1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}"]
    rows = [(i, f"{text(i, r.randrange(3, 9))} {make[i % 4]()} {text(i + 500, 5)}. 12 of 30 on 2024-01-0{i % 9 + 1}") for i in range(400)]
    weights = pii.learned(spark.createDataFrame(rows, "doc_id int, text string"))
    found, clean = {k: [] for k in range(4)}, 0
    for i in range(240):
        k = i % 4
        form = r.choice(pii.forms_of(make[k](), k))
        t = f"{text(i + 1000, 4)} {form} {text(i + 1500, 4)}"
        a = t.index(form)
        _, spans = pii.spans_of(t, weights)
        found[k].append(any(x == k and p < a + len(form) and q > a and min(q, a + len(form)) - max(p, a) >= 0.8 * len(form) for x, p, q in spans))
        clean += len(pii.spans_of(f"{text(i, 6)} 12 of 30 on 2024-01-07 (at 5) {text(i + 3, 4)}", weights)[1])
    assert all(np.mean(v) >= 0.9 for v in found.values()), {k: np.mean(v) for k, v in found.items()}
    assert clean <= 12
    for t, kind in (("write to john [at] example.com today", 0), ("jane (at) mail [dot] org is mine", 0), ("call (017) 555-7713 now", 3), ("call 415-555-0132 now", 3)):
        assert kind in {k for k, _, _ in pii.spans_of(t, weights)[1]}, t


def test_decoding_is_the_best_split():
    r = random.Random(7)
    for _ in range(60):
        t = "".join(r.choice(["7", "12", "@", "a", ".", " "]) for _ in range(7))
        s = pii.Stretch(t)
        weights = {f: np.array([r.uniform(-2, 3) for _ in pii.KINDS]) for fs in s.features for f in fs}
        score = {(i, j): max(sum(weights[f][k] for f in fs) for k in range(4)) for (i, j), fs in zip(s.segments, s.features, strict=True)}
        n = len(s.edges) - 1
        best = [0.0] * (n + 1)
        for j in range(1, n + 1):
            best[j] = max([best[j - 1]] + [best[i] + v for (i, e), v in score.items() if e == j and v > 1.0])
        got = pii.decode(t, weights)
        held = {(s.edges[i], s.edges[j]): v for (i, j), v in score.items()}
        assert sum(held[a, b] for _, a, b in got) == pytest.approx(best[n])


def test_index_of_rules_gives_what_all_rules_give(spark):
    import itertools

    hosts = ["a.casino.example", "x.doubleclick.net", "doubleclick.net", "mydoubleclick.net", "cheap-pills.example.org", "ioam.de", "adserver.site.com", "clean.example.com", "turn.com", "turn.community"]
    urls = [f"http://{h}{p}" for h, p in itertools.product(hosts, ["", "/", "/a.poker.b", "/x?y=.casino."])]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    for r in rows_of(url_filter.filter_urls(d, [], url_filter.METHOD)):
        address = r["host"] + r["path"]
        fits = any(re.search(x.regex, address) for x in url_filter.METHOD)
        assert r["verdict"] == ("block" if fits else "allow"), r


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://NET", "x://a.NET/", "http://a.example.net/en/x?y#z", "http://anet/", "http://b.example.com/de/?q", "http://org/fr/", "http://cheap-pills.example.com/a", "http://x.example.com/DE/"]
    d = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] * 2, "page_id int, url string")
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in rows_of(url_filter.filter_urls(d, url_filter.STATED, url_filter.METHOD))}
    assert got[0] == got[1] == got[2] == ("", None, "allow") and got[3] == ("net", None, "allow") and got[4] == ("a.net", "net/", "block") and got[5] == ("a.example.net", "example.net/en/", "allow")
    assert got[6] == ("anet", None, "allow") and got[7][1:] == ("example.com/de/", "block") and got[8][1:] == ("org/fr/", "allow") and got[9][1:] == (None, "block") and got[10][1:] == (None, "allow")
    assert url_filter.filter_urls(d.limit(0), url_filter.STATED).count() == 0


def test_license_scan(spark):
    mit = license_scan.TEMPLATES["MIT"]
    d = spark.createDataFrame([(1, "x " + mit.replace("without restriction", "with restriction") + " y"), (2, "a Released under the MIT License. b"), (3, None), (4, "free of charge")], "doc_id int, text string")
    got = {r["doc_id"]: r for r in rows_of(license_scan.scan_licenses(d, keep=["doc_id"]))}
    assert set(got) == {1, 2} and got[1]["license_id"] == "MIT" and got[1]["coverage"] > 0.95 and (got[1]["start"], got[1]["end"]) == (2, 2 + len(mit) - 4)
    assert got[2]["license_id"] == "MIT-notice" and got[2]["coverage"] == 1


def test_rights_notice_alone():
    texts = ["one two All rights reserved. three", "Copyright (c) 2024 Acme Corp. All rights reserved.", "Copyright. All rights reserved.", "all rights", "No rights are reserved at all."]
    got = license_scan.matches(license_scan.Index(license_scan.TEMPLATES), pa.array(texts))
    assert [[(m["license_id"], t[m["start"] : m["end"]]) for m in some] for t, some in zip(texts, got, strict=True)] == [
        [("Rights-notice", "All rights reserved")], [("Rights-notice", "All rights reserved")], [("Reserved-notice", "Copyright. All rights reserved")], [], []
    ]


def test_license_versions_and_kinds_are_told_apart():
    texts = ["Licensed under the GNU General Public License, version 2.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-ND 4.0.", "Licensed under CC BY 3.0.", "Licensed under the GNU Lesser General Public License, version 2.1.", "Licensed under the BSD 3-Clause License.", "Licensed under CC BY-NC-SA 2.5 now", "Licensed under CC BY 9.9."]
    got = license_scan.matches(license_scan.Index(license_scan.TEMPLATES), pa.array(texts))
    assert [[m["license_id"] for m in x] for x in got] == [["GPL-2.0-notice"], ["GPL-3.0-notice"], ["CC-BY-ND-4.0-notice"], ["CC-BY-3.0-notice"], ["LGPL-2.1-notice"], ["BSD-3-notice"], ["CC-BY-NC-SA-2.5-notice"], []]


def license_texts():
    r = random.Random(4)
    out = ["Released under the BSD License", "Licensed under the Apache License 2.0", "Released under some MIT License", "Licensed under the MIT License.", "All rights reserved. All rights reserved. All rights reserved.", "license " * 500]
    for t in license_scan.TEMPLATES.values():
        for share in (0, 0.05, 0.15, 0.3):
            w = []
            for x in t.split():
                kind = r.random()
                w += [] if kind < share / 3 else [x, r.choice(WORDS)] if kind < share * 2 / 3 else [r.choice(WORDS)] if kind < share else [x]
            out.append(f"{text(len(out), 9)} {' '.join(w)} {text(len(out), 5)}")
    return [*out, None, ""]


def plain_align(template, text, begin, more=0):
    """A cell at a time: score, matched words and span of the template near ``begin`` to ``begin + more``."""
    band = license_scan.BAND
    score, match, first = {}, {}, {}
    best = (0, 0, 0, 1 << 40)
    template, text = template.tolist(), text.tolist()
    for i, word in enumerate(template):
        for d in range(2 * band + 1 + more):
            j = begin - band + d + i
            same = 0 <= j < len(text) and text[j] == word
            s, m, f = score.get((i - 1, d), 0) + (1 if same else -1), match.get((i - 1, d), 0) + same, first.get((i - 1, d), -1)
            f = j if same and f < 0 else f
            for at in ((i - 1, d + 1), (i, d - 1)):
                known = score[at] if at in score else 0 if i == 0 and at[0] < 0 and at[1] < 2 * band + 1 + more else -(1 << 40)
                if known - 1 > s:
                    s, m, f = known - 1, match.get(at, 0), first.get(at, -1)
            if s <= 0 and m == 0:
                s, f = 0, -1
            score[i, d], match[i, d], first[i, d] = s, m, f
            if m and same and s >= 0 and (s > best[0] or s == best[0] and j + 1 < best[3]):
                best = (s, m, f, j + 1)
    return best if best[1] else (0, 0, 0, 0)


def test_license_alignment_against_cells():
    r = np.random.default_rng(2)
    words = r.integers(0, 6, 120).astype(np.uint64)
    for n, more in ((3, 0), (7, 0), (25, 0), (25, 13), (1, 2)):
        template = words[40 : 40 + n]
        begin = np.arange(-n - 9, 70, 3)
        start, end = np.full(len(begin), 30), np.full(len(begin), 90)
        got = license_scan.align([words[:50], template], np.ones(len(begin), int), words, start, end, begin, more)
        assert [tuple(x) for x in got.tolist()] == [plain_align(template, words[30:90], b, more) for b in begin.tolist()]


def test_license_fingerprints_recall_long_templates():
    from meshwright.llm.arrowtext import ALNUM, Words

    index = license_scan.Index(license_scan.TEMPLATES)
    long = [t for t, w in enumerate(index.words) if len(w) >= license_scan.LONG]
    r, texts = random.Random(11), []
    for t in long:
        words = license_scan.TEMPLATES[index.names[t]].split()
        for share in (0, 0.1, 0.2, 0.3, 0.35):
            for _ in range(4):
                texts.append(text(len(texts), 30) + " " + " ".join(r.choice(WORDS) if r.random() < share else x for x in words) + " " + text(len(texts), 30))
            begin = r.randrange(max(1, int(len(words) * 0.35)))
            texts.append(" ".join(words[begin : begin + int(len(words) * 0.65)]))
    w = Words(pa.array(texts), ALNUM)
    h = w.hashes()
    reached = {(d, t) for d, t, _, _ in license_scan.candidates(index, h, w.ptr)}
    met = total = 0
    for t in long:
        n = len(index.words[t])
        size = np.diff(w.ptr)
        every = license_scan.align(index.words, np.full(len(texts), t), h, w.ptr[:-1], w.ptr[1:], np.full(len(texts), -n), int(size.max()) + 2 * n)
        accepted = {(d, t) for d in np.flatnonzero(every[:, 1] >= index.need[t]).tolist()}
        met, total = met + len(accepted & reached), total + len(accepted)
    assert total > 200 and met >= 0.99 * total


def test_winnowing_meets_every_common_run():
    h = np.random.default_rng(5).integers(0, 2**63, 200).astype(np.uint64)
    g = license_scan.grams(h)
    kept = license_scan.winnowed(g)
    assert len(kept) < 0.7 * len(g) and all(((kept >= a) & (kept < a + license_scan.WINDOW)).any() for a in range(len(g) - license_scan.WINDOW + 1))
    assert len(license_scan.winnowed(g[:0])) == 0 and len(license_scan.winnowed(g[:2])) == 1


def test_license_candidates_against_every_alignment():
    from meshwright.llm.arrowtext import ALNUM, Words

    short = {k: v for k, v in license_scan.TEMPLATES.items() if len(Words(pa.array([v]), ALNUM).start) < license_scan.LONG}
    texts = license_texts()
    for name, template in short.items():
        index = license_scan.Index({name: template})
        w = Words(pa.array(texts), ALNUM)
        h = w.hashes()
        reached = {}
        for d, _, first, last in license_scan.candidates(index, h, w.ptr):
            reached.setdefault(d, set()).update(range(first, last + 1))
        for d in np.flatnonzero(np.diff(w.ptr) < 50).tolist():
            begin = np.arange(-len(index.words[0]) - 8, w.ptr[d + 1] - w.ptr[d] + 9)
            got = license_scan.align(index.words, np.zeros(len(begin), int), h, np.full(len(begin), w.ptr[d]), np.full(len(begin), w.ptr[d + 1]), begin)
            accepted = set(begin[got[:, 1] >= index.need[0]].tolist())
            assert accepted <= reached.get(d, set()), (name, texts[d])


def test_license_texts_edited():
    texts = license_texts()
    got = [[(m["license_id"], t[m["start"] : m["end"]]) for m in some] for t, some in zip(texts, license_scan.matches(license_scan.Index(license_scan.TEMPLATES), pa.array(texts)), strict=True)]
    assert got[:6] == [
        [("BSD-notice", "under the BSD License")], [("Apache-2.0-notice", "Licensed under the Apache License 2.0")], [("MIT-notice", "Released under some MIT License")],
        [("MIT-notice", "under the MIT License")], [("Rights-notice", "All rights reserved")] * 3, [],
    ]
    names = list(license_scan.TEMPLATES)
    assert [g[0][0] for g in got[6:-2:4]] == names
    for some, t in zip(got[6:-2:4], license_scan.TEMPLATES.values(), strict=True):
        assert some[0][1] == t.rstrip("./")  # to its last word, the disclaimer too
    for name in ("MIT", "ISC", "BSD", "BSD-3", "Apache-2.0", "Unlicense"):
        assert [g[0][0] for g in got[6 + 4 * names.index(name) :][:3]] == [name] * 3


def test_toxicity_and_identity(spark):
    rows = [(i, text(i, 12) + (" idiot scum" if i % 4 == 0 else "") + (" women" if i % 4 == 0 or i % 16 == 1 else "")) for i in range(200)]
    d, labels = spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)], "doc_id int, toxic int")
    m = toxicity.learned(d, labels)
    s = m.score(pa.array(["sun idiot scum", "sun women moon", "sun men moon", None, ""]))
    assert s[0] > 0.5 > s[1] and abs(s[1] - s[2]) < 0.2 and s[3] == s[4]
    assert toxicity.learned(d, labels.limit(0)).score(pa.array(["x"]))[0] == pytest.approx(0.5)
    assert toxicity.score_toxicity(d.limit(0), m).count() == 0


def test_counterfactuals_lower_false_positives():
    r = random.Random(3)
    texts = [(int(i % 3 == 0), text(i, 10) + (" women muslims" if i % 3 == 0 and r.random() < 0.9 else "") + (" idiot" if i % 3 == 0 and r.random() < 0.6 else "")) for i in range(300)]
    doc, h, n = toxicity.word_counts(pa.array([t for _, t in texts]))
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    rows = [(y, h[a:b], n[a:b]) for (y, _), a, b in zip(texts, at[:-1], at[1:], strict=True)]
    neutral = pa.array([text(i, 10) + " women muslims" for i in range(900, 960)])
    fair, plain = (toxicity.fit(rows, fairness=f).score(neutral) for f in (5.0, 0.0))
    assert (plain >= 0.5).mean() > 0.9 and (fair >= 0.5).mean() < 0.1
    assert toxicity.fit(rows).score(pa.array([text(1, 10) + " idiot"]))[0] > toxicity.fit(rows).score(pa.array([text(1, 10)]))[0]


def test_language(spark):
    r = random.Random(2)
    word = {"aa": lambda: "".join(r.choice("abcde") for _ in range(5)), "zz": lambda: "".join(r.choice("vwxyz") for _ in range(5))}
    d = spark.createDataFrame([(i, " ".join(word[k]() for _ in range(20)), k) for i in range(60) for k in [("aa", "zz")[i % 2]]] + [(98, None, "aa"), (99, "12 !", "aa")], "doc_id int, text string, lang string")
    got = {x["doc_id"]: x for x in rows_of(langid.predict(d, langid.learned(d)))}
    assert all(got[i]["lang_pred"] == ("aa", "zz")[i % 2] for i in range(60)) and got[98]["lang_pred"] == got[99]["lang_pred"] == "und" and got[99]["rejected"]
    assert rows_of(langid.predict(d.limit(1), None))[0]["lang_pred"] == "und"


def test_base_score(docs):
    from collections import Counter
    from math import log10

    scorer, counts = lm_score.learned(docs)
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    c = Counter(w for r in rows_of(docs) for w in words(r["text"]))
    n, v = sum(c.values()), len(c)
    for r in rows_of(lm_score.score_texts(docs, scorer, counts, keep=["doc_id", "text"])):
        w = words(r["text"])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), len(w), n) and r["score"] < 0
        assert r["base_score"] == pytest.approx(sum(log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel=1e-9)


def test_survey_and_counts_are_the_corpus(docs):
    from collections import Counter

    from meshwright.llm.subwords import Encoder, tokenizer_path

    e = Encoder(tokenizer_path())
    texts = [r["text"] or "" for r in rows_of(docs)]
    table, _ = lm_score.survey(docs.select("text"), tokenizer_path())
    every = Counter(x for t in texts for x in e.encode(pa.array([t]))[0].tolist())
    assert {i: n for i, n in enumerate(table[:, lm_score.ALL].tolist()) if n} == every
    words = Counter(w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)))
    begun, last = np.zeros(lm_score.IDS), np.zeros(lm_score.IDS)
    for w, n in words.items():
        ids, _ = e.encode(pa.array([w]))
        begun[ids[0]] += n
        last[ids[-1]] += n
    assert (table[:, lm_score.WORD_END] == last).all()
    scorer, _ = lm_score.learned(docs, rows=1)
    begun[lm_score.END] = len(texts)
    assert (scorer.of.sum(1) == begun).all()


def some_model(texts):
    from meshwright.llm.subwords import Encoder, tokenizer_path

    s = lm_score.Stream(Encoder(tokenizer_path()), pa.array(texts))
    table = np.zeros((lm_score.IDS, lm_score.BESIDE + 2 * lm_score.NEAR), np.int64)
    table[:, lm_score.ALL] = np.bincount(s.ids, minlength=lm_score.IDS)
    return s, lm_score.Model(*lm_score.classes(table, len(texts)))


def test_batched_attention_is_the_plain_one():
    s, m = some_model([text(i, 30) for i in range(4)] + ["one"])
    got, gates = m.logp(s.row, s.windows, np.isin(np.arange(len(s.row)), s.own))
    p = {k: v.astype(float) for k, v in m.p.items()}
    for n, place in enumerate(s.own.tolist()):
        start = s.windows[np.flatnonzero(s.windows + lm_score.WIDTH - lm_score.STRIDE < place)[-1]]
        seen = [i for i in range(start, place) if s.row[i] != lm_score.PAD]
        at = place - 1
        a = np.array([np.exp(p["q"][s.row[at]] @ p["k"][s.row[i]] + p["place"][at - i]) for i in seen])
        z = np.concatenate([(a[:, None] * p["v"][s.row[seen]]).sum(0) / a.sum(), p["r"][s.row[at]]])
        out = np.exp(z @ p["w"] + p["b"])
        kinds, topics = out[: lm_score.CLASSES], out[lm_score.CLASSES :]
        assert got[place] == pytest.approx(np.log(kinds[m.kind[s.row[place]]] / kinds.sum()), abs=1e-3)
        assert gates[n] == pytest.approx(topics / topics.sum(), abs=1e-3)


def test_training_helps():
    s, m = some_model([text(i, 60) for i in range(100)])
    before = m.logp(s.row, s.windows)[0][s.own].mean()
    m.train(s.row, s.windows, np.zeros(len(s.windows), int), epochs=2)
    assert m.logp(s.row, s.windows)[0][s.own].mean() > before + 0.05


def test_chances_of_words_sum_to_one_at_most(spark):
    d = spark.createDataFrame([(i, text(i, 40)) for i in range(60)], "doc_id int, text string")
    scorer, counts = lm_score.learned(d)
    one = spark.createDataFrame([(i, w) for i, w in enumerate([*WORDS, ""])], "doc_id int, text string")
    end = {r["text"]: r["score"] for r in rows_of(lm_score.score_texts(one, scorer, counts))}
    first = {w: 10 ** end[w] for w in WORDS}  # a word, then the end
    assert sum(first.values()) + 10 ** end[""] <= 1 + 1e-6
    two = spark.createDataFrame([(i, f"red {w}".strip()) for i, w in enumerate([*WORDS, ""])], "doc_id int, text string")
    assert sum(10 ** r["score"] for r in rows_of(lm_score.score_texts(two, scorer, counts))) <= 1 + 1e-6


def test_model_beats_word_counts_on_new_texts(spark):
    r = random.Random(5)
    kinds = [[w + e for w in WORDS] for e in ("", "er", "ung")]
    make = lambda i: " ".join(r.choice(kinds[i % 3]) for _ in range(60))
    d = spark.createDataFrame([(i, make(i)) for i in range(300)], "doc_id int, text string")
    new = spark.createDataFrame([(i, make(i)) for i in range(60)], "doc_id int, text string")
    got = rows_of(lm_score.score_texts(new, *lm_score.learned(d)))
    assert sum(x["score"] for x in got) > sum(x["base_score"] for x in got)


def test_no_training_texts_and_no_texts(docs):
    none = docs.where("false")
    scorer, counts = lm_score.learned(none)
    got = rows_of(lm_score.score_texts(docs, scorer, counts))
    assert len(got) == docs.count() and all(np.isfinite(x["score"]) and x["n_known"] == 0 for x in got)
    assert lm_score.score_texts(none, scorer, counts).count() == 0


def test_clashing_names_give_way(docs):
    clash = docs.selectExpr("*", "1 AS sequence_id", "2 AS offset", "3 AS n_tokens", "'x' AS license_id", "5 AS n_words", "6 AS lang_pred")
    out = pack.pack_documents(clash)
    assert len(set(out.columns)) == len(out.columns) and out.where("offset >= 0").count() == out.count()
    scored = lm_score.score_texts(clash, *lm_score.learned(clash, rows=5))
    assert len(set(scored.columns)) == len(scored.columns) and dict(scored.dtypes)["score"] == "double"
    for df in (license_scan.scan_licenses(clash), toxicity.score_toxicity(clash, toxicity.fit([])), langid.predict(clash, None), decontaminate.decontaminate(clash, docs.selectExpr("doc_id AS item_id", "text"))):
        assert len(set(df.columns)) == len(df.columns) and df.count() >= 0


def test_pipeline_keeps_columns(spark, tmp_path, docs):
    import corpus_pipeline

    docs.dropDuplicates(["doc_id"]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, text(4, 60))], "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.dtypes == at.dtypes
            out.write.parquet(str(tmp_path / f"{k}"))
            at = spark.read.parquet(str(tmp_path / f"{k}"))
    assert 4 not in {r["doc_id"] for r in rows_of(out)} and {1, 2, 5} <= {r["doc_id"] for r in rows_of(out)}


def test_common_subsequences():
    def longest(a, b):
        d = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], last + 1 if x == y else max(d[j], d[j - 1])
        return d[-1]

    r = random.Random(2)
    for _ in range(200):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randrange(40))) for _ in range(2))
        assert fingerprint._common(a, b) == longest(a, b)
    for i in range(20):
        t = text(i, 300)
        x, y = fingerprint.fingerprint(t.encode()), fingerprint.fingerprint((t[: r.randrange(200, len(t))] + text(i + 50, 20)).encode())
        assert fingerprint.likeness(x, y) == fingerprint.likeness(y, x) and 0 <= fingerprint.likeness(x, y) <= 1


def test_empty_tables(docs):
    none = docs.where("false")
    assert ngram_join.near_duplicates(none).count() == pack.pack_documents(none, keep=["doc_id"]).count() == fingerprint.against_next(none).count() == 0
    assert langid.predict(none, langid.learned(none)).count() == license_scan.scan_licenses(none).count() == pii.find_pii(none, {}).count() == 0
    assert decontaminate.decontaminate(none, docs.selectExpr("doc_id AS item_id", "text")).count() == 0
    items = docs.selectExpr("doc_id AS item_id", "text")
    assert decontaminate.decontaminate(docs, items.limit(0)).where("n_hit > 0 OR contaminated").count() == 0


def test_weights_move_by_the_mean_of_the_tasks_that_met_them(spark):
    _, model = some_model(["one two three two one", "three two one"])
    flat = model.flat()
    r = np.random.default_rng(5)
    rows = [(at, r.integers(0, 3, 4).astype(np.float32), float(r.integers(1, 9))) for _ in range(60) for at in (0, 4)]
    changes = spark.createDataFrame([(at, bytearray(x.tobytes()), n) for at, x, n in rows], "at long, change binary, windows double").repartition(9)
    want = flat.copy()
    for at in (0, 4):
        own = [(x, n) for a, x, n in rows if a == at]
        want[at : at + 4] += sum(x * n for x, n in own) / np.maximum(sum((x != 0) * n for x, n in own), 1)
    assert np.allclose(lm_score.moved(model, changes).flat(), want, atol=1e-5)
    assert np.array_equal(lm_score.moved(model, changes.where("false")).flat(), flat)


def test_rows_of_a_task_hold_what_it_met():
    """Counts and changes of a task are as large as what it met, and are whole."""
    x = np.zeros((lm_score.SURVEY_ROW, 67), np.int64)
    x[[3, 500], [0, 66]] = 7, 1 << 40
    data = lm_score.told(x)
    assert len(data) == 2 * 12
    places, n = lm_score.read(data, np.int64)
    assert {(p // 67, p % 67): v for p, v in zip(places.tolist(), n.tolist(), strict=True)} == {(3, 0): 7, (500, 66): 1 << 40}
    one = pa.table({"change": pa.array([lm_score.told(np.array([0, 2, 0, 1], np.float32)), lm_score.told(np.array([0, 4], np.float32))]), "windows": [1.0, 3.0]})
    added = lm_score._added((pa.scalar(0),), one)
    assert np.frombuffer(lm_score._mean((pa.scalar(0),), added)["change"][0].as_buffer(), np.float32)[:5].tolist() == [0, 3.5, 0, 1, 0]


def test_a_worker_keeps_its_encoder():
    from meshwright.llm.subwords import kept_encoder, tokenizer_path

    e = kept_encoder(tokenizer_path())
    e.encode(pa.array(["one two three"]))
    met = e.n
    assert kept_encoder(tokenizer_path()) is e
    e.encode(pa.array(["three two one"]))
    assert e.n == met
