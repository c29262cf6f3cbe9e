"""License scan: winnowed fingerprints of templates in an inverted index pick candidates, banded alignment settles them.

Words are runs of ASCII letters and digits and of characters beyond ASCII, in lower case. A match holds at least ``COVER``
of a template's words (``COVER_SHORT`` of one under ten words). Of a template of ``LONG`` words and more the grams of ``GRAM`` words
are winnowed: of each ``WINDOW`` neighbouring grams the least hash is a fingerprint, so a run of GRAM + WINDOW - 1 words in common
shares one. The index holds fingerprints with template and place. A text's grams look themselves up there; where a sixteenth of a template's
fingerprints (one at least) agree on where it would begin, within ``BAND`` words either way, stands a candidate. A shorter template is a
window by itself: its fingerprints are single words. Of n words with ``need`` to match, the n - need + ``least`` rarest (by the templates'
own counts) are filed, so any match meets at least ``least`` (half of ``need``) of them, and no match that the alignment would
accept is without a candidate; for long templates the tests measure recall against alignment everywhere. A dynamic
programme over that band aligns template and text and gives the matched words and the text's span: about every
candidate place for templates under ``LONG`` words, about every ``BAND``-th and once over all neighbouring places for longer ones.
All places of a template in a batch are aligned at once, a front of the band's cells at a time.

A match of a template under ``LONG`` words must hold the template's telling words (numbers, and such as "SA" or "Lesser"), these
alone and in order: a notice of version 2 is no match of version 3's. Coverage is of the template, which is a notice or the text
from its first term on.

Matches of a text don't overlap; the one of more matched words stays, then of fewer edits, the earlier, the shorter
template's. Null, empty and unlicensed texts have no match, so no row; repeated rows have a match each. License texts
come whole, and once more without their disclaimer ("-terms") where that is less than ``COVER`` of the whole. The
templates are broadcast; their size is checked. Texts of any length are read whole. An empty table gives an empty result.
Columns of the input named as an output column are replaced.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import ALNUM, Words, map_text

BAND, LONG = 8, 20
#: Words of a gram, and grams of a winnowing window.
GRAM, WINDOW = 3, 3
COVER, COVER_SHORT = 0.6, 0.8
#: Cells of alignments held at once.
ALIGNED = 1 << 18
#: Template words that may be broadcast; a larger set is an error.
WORDS_HELD = 2_000_000

#: License texts and notices (fixed values).
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-notice": "Released under the MIT License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-notice": "Licensed under the BSD License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Reserved-notice": "Copyright All rights reserved.",
    "Rights-notice": "All rights reserved.",
}

#: Families of short notices: versions and kinds by rule.
for _name, _words, _versions in (("GPL", "General", "1 2 3"), ("LGPL", "Lesser General", "2 2.1 3"), ("AGPL", "Affero General", "3")):
    for _v in _versions.split():
        TEMPLATES[f"{_name}-{_v if '.' in _v else _v + '.0'}-notice"] = f"Licensed under the GNU {_words} Public License, version {_v}."
for _kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
    for _v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        TEMPLATES[f"CC-{_kind}-{_v}-notice"] = f"Licensed under CC {_kind} {_v}."
for _v in ("3.0", "4.0"):
    TEMPLATES[f"CC-BY-{_v}"] = f"This work is licensed under a Creative Commons Attribution {_v} International License."
for _v in ("2", "3"):
    TEMPLATES[f"BSD-{_v}-notice"] = f"Licensed under the BSD {_v}-Clause License."
TEMPLATES["GPL-2.0"] = TEMPLATES["GPL-3.0"].replace("version 3", "version 2")
#: Words that tell licenses of a family apart, beside numbers (fixed values).
TELLING = ("lesser", "affero", "sa", "nc", "nd")

#: What follows the terms above in the whole texts (fixed values).
DISCLAIMERS = {
    "MIT": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
}
ENDORSEMENT = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
TEMPLATES["BSD-3"] = f"{TEMPLATES['BSD']} {ENDORSEMENT} {DISCLAIMERS['BSD']}"
for _name, _rest in DISCLAIMERS.items():
    TEMPLATES[f"{_name}-terms"] = TEMPLATES[_name]
    TEMPLATES[_name] += " " + _rest


def needed(n: int) -> int:
    """Words of a template of ``n`` that a match holds at least."""
    return math.ceil((COVER if n >= 10 else COVER_SHORT) * n)


def grams(h: np.ndarray) -> np.ndarray:
    """A hash of each run of ``GRAM`` of the words' hashes."""
    n = max(0, len(h) - GRAM + 1)
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)  # wraps
        out ^= out >> np.uint64(29)
    return out


def winnowed(g: np.ndarray) -> np.ndarray:
    """Places of the least of each ``WINDOW`` neighbours (the last of equal ones); of fewer, the least."""
    if len(g) <= WINDOW:
        return np.array([len(g) - 1 - int(np.argmin(g[::-1]))]) if len(g) else np.zeros(0, np.int64)
    seen = np.lib.stride_tricks.sliding_window_view(g, WINDOW)[:, ::-1]
    return np.unique(np.arange(len(seen)) + WINDOW - 1 - np.argmin(seen, 1))


class Filed:
    """An inverted index: hashes with the templates and places that hold them."""

    def __init__(self, found: list[tuple[int, int, int]]):
        found = sorted(found)
        self.keys = np.array([f[0] for f in found], np.uint64)
        self.template, self.place = (np.array([f[k] for f in found], np.int64) for k in (1, 2))
        self.table = np.zeros(1 << 18, bool)
        self.table[self.keys >> np.uint64(46)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``h``, template, its place) of all that are filed."""
        at = np.flatnonzero(self.table[h >> np.uint64(46)])
        lo, hi = np.searchsorted(self.keys, h[at], "left"), np.searchsorted(self.keys, h[at], "right")
        n = hi - lo
        k = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
        return np.repeat(at, n), self.template[k], self.place[k]


class Index:
    def __init__(self, templates: dict[str, str]):
        import pyarrow as pa

        self.names = sorted(templates)
        self.words = [Words(pa.array([templates[n]]), ALNUM).hashes() for n in self.names]
        every, counts = np.unique(np.concatenate([*self.words, np.zeros(0, np.uint64)]), return_counts=True)
        self.need = [needed(len(h)) for h in self.words]
        self.telling = [self._telling(t) if len(h) < LONG else None for t, h in zip((templates[n] for n in self.names), self.words, strict=True)]
        self.least = np.array([(n + 1) // 2 for n in self.need], np.int64)
        single, runs = [], []
        for t, h in enumerate(self.words):
            if len(h) < LONG:
                rare = np.argsort(counts[np.searchsorted(every, h)], kind="stable")[: len(h) - self.need[t] + int(self.least[t])]
                single += [(int(h[i]), t, i) for i in rare.tolist()]
            else:
                g = grams(h)
                prints = winnowed(g).tolist()
                self.least[t] = max(1, len(prints) // 16)
                runs += [(int(g[i]), t, i) for i in prints]
        self.single, self.runs = Filed(single), Filed(runs)

    @staticmethod
    def _telling(text: str) -> list[bytes]:
        import pyarrow as pa

        w = Words(pa.array([text]), ALNUM)
        return [x for i in range(len(w.start)) if tells(x := w.word(i))]


def tells(word: bytes) -> bool:
    return word.isdigit() or word.decode("utf-8", "replace") in TELLING


def align(templates: list[np.ndarray], which: np.ndarray, words: np.ndarray, start: np.ndarray, end: np.ndarray, begin: np.ndarray, more: int = 0) -> np.ndarray:
    """Rows (score, matched words, first word, past the last): templates ``which`` in texts ``words[start:end]``, near ``begin`` to ``begin + more``.

    Words match for 1, others and gaps cost 1; what a text has before and after the template is free. Of equal scores the
    earlier end stays. Cells of template word i and diagonal d, text word begin - BAND + d + i, hang on those of 2 i + d less 1 and
    less 2, so all cells of one sum are computed at once, for all texts.
    """
    used, row = np.unique(which, return_inverse=True)
    sizes = np.array([len(templates[t]) for t in used.tolist()], np.int64)
    width, rows, n = 2 * BAND + 1 + more, len(begin), int(sizes.max(initial=0))
    if not n or not len(words):
        return np.zeros((rows, 4), np.int64)
    whole = np.zeros((len(used), n), np.uint64)
    for k, t in enumerate(used.tolist()):
        whole[k, : sizes[k]] = templates[t]
    whole, sizes = whole[row], sizes[row]
    score, match, first = (np.zeros((rows, width + 2), np.int64) for _ in range(3))  # a diagonal's latest cell; one more at either side
    first[:] = -1
    score[:, 0] = score[:, -1] = -(1 << 40)
    best = np.zeros((rows, 4), np.int64)
    best[:, 3] = 1 << 40
    far = len(words) - 1
    for front in range(2 * (n - 1) + width):
        d = np.arange(max(front % 2, front - 2 * (n - 1)), min(width - 1, front) + 1, 2)
        i = (front - d) // 2
        j = (begin - BAND)[:, None] + d + i
        same = words[np.minimum(np.maximum(j + start[:, None], 0), far)] == whole[:, i]
        same &= (j >= 0) & (j < (end - start)[:, None]) & (i < sizes[:, None])
        at = slice(d[0] + 1, d[-1] + 2, 2)
        s, m, f = score[:, at] + np.where(same, 1, -1), match[:, at] + same, first[:, at]
        f = np.where(same & (f < 0), j, f)
        for side in (slice(d[0] + 2, d[-1] + 3, 2), slice(d[0], d[-1] + 1, 2)):  # the template's word is missing; the text has a word too many
            s2 = score[:, side] - 1
            over = s2 > s
            s, m, f = np.where(over, s2, s), np.where(over, match[:, side], m), np.where(over, first[:, side], f)
        free = (s <= 0) & (m == 0)
        s, f = np.where(free, 0, s), np.where(free, -1, f)
        score[:, at], match[:, at], first[:, at] = s, m, f
        can = np.where(same & (m > 0), s, -1)
        top = can.max(1)
        for r in np.flatnonzero((top > best[:, 0]) | ((top == best[:, 0]) & (top >= 0))).tolist():
            k = int(np.argmin(np.where(can[r] == top[r], j[r], 1 << 40)))
            if top[r] > best[r, 0] or j[r, k] + 1 < best[r, 3]:
                best[r] = top[r], m[r, k], f[r, k], j[r, k] + 1
    best[best[:, 1] == 0] = 0
    return best


def candidates(index: Index, h: np.ndarray, ptr: np.ndarray):
    """(text, template, first, last): where templates may begin, places with less than two between them taken together."""
    at, t, place = index.single.hits(h)
    run, t2, place2 = index.runs.hits(grams(h))
    whole = run + GRAM <= ptr[np.searchsorted(ptr, run, "right")] if len(run) else np.zeros(0, bool)  # within one text
    at, t, place = (np.concatenate(x) for x in ((at, run[whole]), (t, t2[whole]), (place, place2[whole])))
    doc = np.searchsorted(ptr, at, "right") - 1
    longest = max(map(len, index.words), default=0)
    span = len(h) + longest + 4 * BAND + 4  # groups of a text and template lie further apart than a band
    key = (doc * len(index.names) + t) * span + at - ptr[doc] - place + longest
    order = np.argsort(key, kind="stable")
    key, t, place = key[order], t[order], place[order]
    until = np.arange(len(key)) + index.least[t] - 1
    full = np.flatnonzero(until < len(key))
    full = full[key[until[full]] - key[full] <= 2 * BAND]
    if not len(full):
        return
    # the band about each place from `first` to `last` holds the hits full .. until
    first, last = key[until[full]] - BAND, key[full] + BAND
    heads = np.flatnonzero(np.append(True, first[1:] > np.maximum.accumulate(last)[:-1] + 1))
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(full)], strict=True):
        i, j = full[a], until[full[b - 1]]
        if len(set(place[i : j + 1].tolist())) >= index.least[t[i]]:  # repeats of a word alone are no match
            group = int(key[i]) // span
            zero = group * span + longest
            yield group // len(index.names), group % len(index.names), int(first[a:b].min()) - zero, int(last[a:b].max()) - zero


def matches(index: Index, texts) -> list[list[dict]]:
    w = Words(texts, ALNUM)
    h = w.hashes()
    out: list[list[dict]] = [[] for _ in range(len(w.ptr) - 1)]
    found: dict[int, set[tuple[int, int, int, int, int]]] = {}
    tries: dict[tuple[int, int], list[tuple[int, int, int]]] = {}  # (words at most, more): (template, text, begin)
    for d, t, first, last in candidates(index, h, w.ptr):
        if len(index.words[t]) < LONG:
            tries.setdefault((LONG, 0), []).extend((t, d, begin) for begin in range(first, last + 1))
        else:
            size = 1 << len(index.words[t]).bit_length()
            tries.setdefault((size, 0), []).extend((t, d, begin) for begin in [*range(first, last, BAND), last])
            if last > first:
                tries.setdefault((size, last - first), []).append((t, d, first))
    for (size, more), places in tries.items():
        step = max(1, ALIGNED // (2 * BAND + 1 + more + size))
        for k in range(0, len(places), step):
            which, d, begin = np.array(places[k : k + step]).T
            got = align(index.words, which, h, w.ptr[d], w.ptr[d + 1], begin, more)
            for t, text, (s, m, a, b) in zip(which.tolist(), d.tolist(), got.tolist(), strict=True):
                told = index.telling[t]
                if m and m >= index.need[t] and (told is None or [x for i in range(w.ptr[text] + a, w.ptr[text] + b) if tells(x := w.word(i))] == told):
                    found.setdefault(text, set()).add((m, s, a, b, t))
    for d, some in found.items():
        taken: list[tuple[int, int]] = []
        for m, _, a, b, t in sorted(some, key=lambda x: (-x[0], -x[1], x[2], len(index.words[x[4]]), x[4])):
            if all(b <= p or a >= q for p, q in taken):
                taken.append((a, b))
                start, end = int(w.start[w.ptr[d] + a]), int(w.end[w.ptr[d] + b - 1])
                points = lambda x, d=d: int(np.count_nonzero((w.raw[w.at[d] : x] & 0xC0) != 0x80))
                out[d].append({"license_id": index.names[t], "coverage": m / len(index.words[t]), "matched_words": m, "start": points(start), "end": points(end)})
    return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """A row a match: ``keep``, license_id, coverage, matched_words, start and end (code points, end exclusive)."""
    templates = TEMPLATES if templates is None else templates
    keep = list(docs.columns if keep is None else keep)
    index = Index(templates)
    if sum(map(len, index.words)) > WORDS_HELD:
        raise ValueError(f"more than {WORDS_HELD} words of templates: scan them in several calls, matches settle within a call")
    held = docs.sparkSession.sparkContext.broadcast(index)
    found = map_text(docs, lambda: lambda texts: {"_found": matches(held.value, texts)}, "_found array<struct<license_id:string,coverage:double,matched_words:int,start:int,end:int>>", text, keep)
    return found.select(*(f"`{c}`" for c in keep if c not in ("license_id", "coverage", "matched_words", "start", "end")), F.inline("_found"))


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
