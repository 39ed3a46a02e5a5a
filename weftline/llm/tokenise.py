"""Token ids of many texts by a tokenizer file of the tokenizers library.

For a byte-level BPE with the usual split pattern, the library is asked once for each
distinct piece and worker: a numpy pass cuts the texts into the pieces that the
pattern gives, and a bounded table by 64-bit hash keeps the ids that the library
returned. BPE never joins across pieces, so ids are those of whole texts. Texts with
characters outside the ranges whose classes are fixed here, or with the string of an
added token, go to the library whole, as do all texts under any other tokenizer.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from weftline.llm import _words as W

LETTER, NUMBER, BLANK = 1, 2, 3
#: The characters of the property White_Space.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
KNOWN = [(0, 0x590), (0x2000, 0x2070)]
_KINDS: np.ndarray | None = None
_CODES = W.mix(np.arange(1, 0x2071, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def kinds() -> np.ndarray:
    """Class of every known character; 255: not known."""
    global _KINDS
    if _KINDS is None:
        import unicodedata

        t = np.full(0x2071, 255, np.uint8)
        for a, b in KNOWN:
            for c in range(a, b):
                t[c] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], 0)
        t[[c for c in WHITE_SPACE if t[min(c, 0x2070)] != 255]] = BLANK
        _KINDS = t
    return _KINDS


def pieces(c: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Flags of the characters at which a piece of the split pattern begins."""
    n = len(c)
    start = np.ones(n + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:n])
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start |= edge
    # the last of several blanks before a visible character stands alone, or joins it if it is a space
    last = np.flatnonzero((kind[:-1] == BLANK) & (kind[1:] != BLANK) & ~edge[1:n])
    start[last] = True
    start[last[c[last] == 32] + 1] = False
    # 's 't 'm 'd 're 've 'll where the apostrophe begins a piece
    q = np.flatnonzero((c[:-1] == 39) & start[: n - 1] & ~edge[1:n])
    a = c[q + 1]
    b = np.where((q + 2 < n) & ~edge[np.minimum(q + 2, n)], c[np.minimum(q + 2, n - 1)], 0)
    two = np.isin(a, [ord(x) for x in "stmd"])
    three = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    for found, k in ((q[two], 2), (q[three], 3)):
        start[found + 1] = False
        start[found + k] = True
    return start


class Encoder:
    """Ids of texts; remembers the pieces it has met, up to ``most`` of them."""

    def __init__(self, definition: str, most: int = 3_000_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_str(definition)
        self.usual = self.whole.pre_tokenizer
        j = json.loads(definition)
        pre, model = j.get("pre_tokenizer") or {}, j["model"]
        self.fast = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not j.get("normalizer") and not j.get("post_processor") and model["type"] == "BPE" and not model.get("dropout")
        self.special = [t["content"].encode() for t in j.get("added_tokens", [])]
        self.size = self.whole.get_vocab_size()
        self.dtype = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.most = most
        if self.fast:
            self.unsplit = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.bytes_of = np.zeros(self.size, np.int64)
            for token, k in self.whole.get_vocab().items():
                self.bytes_of[k] = len(token)  # a character stands for a byte
            self._clear()

    def _clear(self) -> None:
        self.keys, self.at, self.many, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, self.dtype)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        if len(self.keys) + len(keys) > self.most:
            self._clear()
        ids, many = [self.flat], []
        self.whole.pre_tokenizer = self.unsplit
        for a in range(0, len(texts), 4000):
            own, count = self._ask(texts[a : a + 4000])
            ids.append(own)
            many.append(count)
        self.whole.pre_tokenizer = self.usual
        many = np.concatenate(many)
        at = len(self.flat) + np.cumsum(many) - many
        self.flat = np.concatenate(ids)
        order = np.argsort(keys)
        to = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, to, keys[order])
        self.at = np.insert(self.at, to, at[order])
        self.many = np.insert(self.many, to, many[order])

    def _ask(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after another, and how many each has: told by the bytes that ids stand for."""
        ids = np.array(self.whole.encode_batch_fast([texts], is_pretokenized=True, add_special_tokens=False)[0].ids, self.dtype)
        ends, reached = np.cumsum([len(t.encode()) for t in texts]), np.cumsum(self.bytes_of[ids])
        last = np.searchsorted(reached, ends)
        if len(ids) and last[-1] == len(ids) - 1 and np.array_equal(reached[last], ends):
            return ids, np.diff(last, prepend=-1)
        e = self.whole.encode(texts, is_pretokenized=True, add_special_tokens=False)  # an id stands for other bytes than its own
        return np.array(e.ids, self.dtype), np.bincount(np.array(e.word_ids, np.int64), minlength=len(texts))

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Where keys are or belong in the table; in ascending order, so that the search stays within the cache."""
        order = np.argsort(keys)
        slot = np.empty(len(keys), np.int64)
        slot[order] = np.searchsorted(self.keys, keys[order])
        return slot

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in data one after another, and the offsets of each text's ids; -1 marks texts that are not known."""
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        text = data.tobytes().decode("utf-8", "replace")
        c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        table = kinds()
        kind = table[np.minimum(c, len(table) - 1)]
        start = pieces(c, kind, chars) if len(c) > 1 else np.ones(len(c) + 1, bool)
        s = np.flatnonzero(start[:-1]) if len(c) else np.zeros(0, np.int64)
        e = np.append(s[1:], len(c))
        h = np.empty(len(s), np.uint64)
        a = 0
        while a < len(s):
            b = max(a + 1, int(np.searchsorted(e, s[a] + W.CHUNK, "right")))
            h[a:b] = W.span_hashes(_CODES[np.minimum(c[s[a] : e[b - 1]], len(_CODES) - 1)], s[a:b] - s[a], e[a:b] - s[a])
            a = b
        code, distinct = pd.factorize(h)
        first = np.empty(len(distinct), np.int64)
        first[code[::-1]] = np.arange(len(h))[::-1]
        odd, sound = np.zeros(0, np.int64), np.ones(len(distinct), bool)
        if (kind == 255).any():
            bad = np.concatenate([[0], np.cumsum(kind == 255)])
            sound = bad[e[first]] == bad[s[first]]
            odd = np.flatnonzero(bad[chars[1:]] != bad[chars[:-1]])
        slot = np.minimum(self._find(distinct), max(0, len(self.keys) - 1))
        new = sound & (self.keys[slot] != distinct if len(self.keys) else np.ones(len(distinct), bool))
        if new.any():
            size = len(self.keys)
            self._learn(distinct[new], [text[x:y] for x, y in zip(s[first[new]].tolist(), e[first[new]].tolist(), strict=True)])
            if len(self.keys) < size + new.sum():  # the table was emptied
                sound_known = sound & ~new
                self._learn(distinct[sound_known], [text[x:y] for x, y in zip(s[first[sound_known]].tolist(), e[first[sound_known]].tolist(), strict=True)])
            slot = np.minimum(self._find(distinct), len(self.keys) - 1)
        many = np.where(sound, self.many[slot] if len(self.many) else 0, 0)[code].astype(np.int64)
        at = (self.at[slot] if len(self.at) else np.zeros(len(distinct), np.int64))[code]
        ends = np.concatenate([[0], np.cumsum(many)])
        ids = self.flat[np.repeat(at - ends[:-1], many) + np.arange(ends[-1])] if len(code) else np.zeros(0, self.dtype)
        out = ends[np.searchsorted(s, chars)]
        return ids, out, odd

    def encode(self, column: pa.Array, end_id: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per slice: index of its first text, ids, offsets of each text's ids (with the end id)."""
        for a, b, data, offsets in W.slices(column, 1_000_000):
            if self.fast:
                ids, out, odd = self._pieces(data, offsets)
                raw = data.tobytes()
                marked = {i for t in self.special if t in raw for i in range(b - a) if t in raw[offsets[i] : offsets[i + 1]]}
                whole = sorted({*odd.tolist(), *marked})
            else:
                ids, out, whole = np.zeros(0, self.dtype), np.zeros(b - a + 1, np.int64), list(range(b - a))
            parts = [ids[x:y] for x, y in zip(out[:-1], out[1:], strict=True)] if whole else None
            if whole:
                texts = [data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in whole]
                for i, e in zip(whole, self.whole.encode_batch(texts, add_special_tokens=False), strict=True):
                    parts[i] = np.array(e.ids, self.dtype)
                ids, out = np.concatenate(parts) if parts else ids, np.concatenate([[0], np.cumsum([len(x) for x in parts])])
            if end_id is not None:
                ids = np.insert(ids, out[1:], end_id)
                out = out + np.arange(len(out))
            yield a, ids, out
