"""Subword ids of whole texts by a public tokenizer, segment by segment.

The tokenizer lowers the case, parts a text at white space and parts words into letters, single digits and the rest,
before it looks at any of them. So a text's ids are the ids of such segments on end. A worker keeps the ids of segments
that its tasks have met in a table of fixed size and asks the tokenizer's own vocabulary model for new ones, all of a slice at
once. Words whose parting is less plain (apostrophes, ``<`` of special tokens, control characters, characters beyond the
Latin blocks) go to the tokenizer as they are.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from .arrowtext import LOWER, _BASE, _BYTES, _INVERSE, buffers, mix, powers

#: Slots of a worker's table of segments, and the ids it may hold before it starts anew.
SLOTS = 1 << 21
IDS_KEPT = 6_000_000

_CLASS = np.full(256, 3, np.int8)  # punctuation
_CLASS[[32, *range(9, 14)]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
#: Bytes that send their word to the whole tokenizer: apostrophe, "<", control characters, leads beyond U+00C0..U+027F.
_ODD = np.zeros(256, bool)
_ODD[[39, 60, 127, *range(9), *range(14, 32), *range(0xC0, 0xC3), *range(0xCA, 256)]] = True
_SPACE, _DIGIT, _WHOLE = 0, 2, 4


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in shown else next(rest)) for b in range(256)}


_kept: dict[str, Encoder] = {}


def kept_encoder(path: str) -> Encoder:
    """A worker's encoder, which knows the segments that its tasks have met: a worker takes many tasks, and new segments are what costs."""
    if path not in _kept:
        _kept.clear()
        _kept[path] = Encoder(path)
    return _kept[path]


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            plain = json.load(f) | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}}
        self.plain = Tokenizer.from_str(json.dumps(plain))
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.shown = {b: c for b, c in byte_letters().items() if b != 32}
        self.key, self.row = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self._clear()

    def _clear(self) -> None:
        self.row[:] = 0
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)  # of each row; row 0 is no segment
        self.n = 1

    def _ids(self, plain: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids on end and how many each segment has."""
        text = b" ".join(plain).decode("utf-8", "replace").lower().encode().decode("latin-1").translate(self.shown)
        ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        size = np.diff(np.flatnonzero(self.last[ids]), prepend=-1)
        return (ids, size) if len(size) == len(plain) else self._whole(plain)

    def _whole(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]
        return np.array([y for x in got for y in x], np.uint32), np.array([len(x) for x in got], np.int64)

    def _add(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        at, k = int(self.ends[self.n - 1]), len(size)
        if at + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(at + 2 * len(ids), np.uint32)])
        if self.n + k > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(self.n + 2 * k, np.int64)])
        self.ids[at : at + len(ids)] = ids
        self.ends[self.n : self.n + k] = at + np.cumsum(size)
        self.n += k
        return np.arange(self.n - k, self.n)

    def segments(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, where texts begin, class of each byte, starts and ends of segments, and their hashes."""
        raw, at = buffers(texts)
        n = len(raw)
        kind = _CLASS[raw]
        odd = _ODD[raw]
        pair = (raw[:-1].astype(np.uint16) << 8) | raw[1:]
        odd[:-1] |= (pair == 0xC397) | (pair == 0xC3B7) | (pair == 0xC4B0)
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        if odd.any():
            inside = kind != _SPACE
            first = inside.copy()
            first[1:] &= ~inside[:-1] | edge[1:n]
            last = inside.copy()
            last[:-1] &= ~inside[1:] | edge[1:n]
            a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
            total = np.concatenate([[0], np.cumsum(odd)])
            bad = total[b] > total[a]
            mark = np.zeros(n + 1, np.int32)
            mark[a[bad]] += 1
            np.subtract.at(mark, b[bad], 1)
            kind = np.where(np.cumsum(mark[:n]) > 0, np.int8(_WHOLE), kind)
        change = edge[:n].copy()
        change[1:] |= kind[1:] != kind[:-1]
        start = np.flatnonzero((change | (kind == _DIGIT)) & (kind != _SPACE))
        stop = np.zeros(n, bool)
        stop[:-1] = change[1:] | (kind[1:] == _DIGIT)
        if n:
            stop[-1] = True
        end = np.flatnonzero(stop & (kind != _SPACE)) + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[np.where(kind == _WHOLE, raw, LOWER[raw])] * powers(_BASE, n), out=total[1:])
        h = mix((total[end] - total[start]) * powers(_INVERSE, n)[start]) if n else total[:0]
        return raw, at, kind, start, end, h

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids on end, and where each text's begin (one more entry than texts)."""
        ids, at, start, where = self.encode_segments(texts)
        return ids, where[np.searchsorted(start, at)]

    def encode_segments(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids on end; where texts begin and where segments begin in bytes; where each segment's ids begin."""
        raw, at, kind, start, end, h = self.segments(texts)
        if self.ends[self.n - 1] > IDS_KEPT:
            self._clear()
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        row = np.where(self.key[slot] == h, self.row[slot], 0)
        missing = np.flatnonzero(row == 0)
        if len(missing):
            keys, first, which = np.unique(h[missing], return_index=True, return_inverse=True)
            i = missing[first]
            fresh = np.zeros(len(keys), np.int64)
            for mask, ask in ((kind[start[i]] != _WHOLE, self._ids), (kind[start[i]] == _WHOLE, self._whole)):
                if mask.any():
                    data = raw.tobytes()
                    fresh[mask] = self._add(*ask([data[a:b] for a, b in zip(start[i[mask]].tolist(), end[i[mask]].tolist(), strict=True)]))
            row[missing] = fresh[which]
            slots = (keys & np.uint64(SLOTS - 1)).astype(np.int64)
            self.key[slots], self.row[slots] = keys, fresh
        begin = self.ends[row - 1]
        size = self.ends[row] - begin
        where = np.zeros(len(row) + 1, np.int64)
        np.cumsum(size, out=where[1:])
        ids = self.ids[np.arange(where[-1]) + np.repeat(begin - where[:-1], size)]
        return ids, at, start, where
