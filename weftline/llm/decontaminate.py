"""Benchmark decontamination by Wu-Manber search over words.

Symbols are words, the patterns are the benchmark's windows of ``window`` words (an
item of fewer words is one shorter window). Patterns of one length m share a shift
table over hashed blocks of two words (one word where m is 1): a block that ends no
pattern lets the search jump ahead by up to m-1 words, a block with shift 0 names the
suffix bucket whose patterns are compared, first by word codes, then byte for byte.
Thousands of segments of a slice advance together, one numpy step a jump.

The benchmark is compiled on the executors into shards of bounded size in the shared
workspace; every task loads one shard at a time, so neither the driver nor a task
holds more than one, and documents are read once.

Words are maximal runs of ASCII letters, digits and all beyond ASCII, after A-Z are
lower-cased. Nulls and texts without words have no words and no windows; an empty
benchmark contaminates nothing. Repeated rows and ids are treated row by row, a
repeated item id counts once for a document; a null item id counts as the empty
string. Input columns named like a result column are replaced.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import _words as W
from weftline.llm._store import get, put, tidy, workspace

WINDOW = 10
SHARD_ITEMS = 20_000
LANES = 2048
RESULT = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def _block(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return (W.mix(a * np.uint64(0xC2B2AE3D27D4EB4F) + b) >> np.uint64(64 - bits)).astype(np.int64)


class Length:
    """All patterns of m words: shift table, suffix buckets, word codes and texts."""

    def __init__(self, m: int, found: dict[bytes, set], codes: dict[bytes, np.ndarray]):
        self.m, self.b = m, min(2, m)
        self.texts = sorted(found)
        self.items = [sorted(found[t]) for t in self.texts]
        self.codes = np.array([codes[t] for t in self.texts], np.uint64)
        self.bits = min(24, max(12, int(np.ceil(np.log2(8 * m * len(self.texts) + 1)))))
        self.shift = np.full(1 << self.bits, m - self.b + 1, np.int8)
        for end in range(self.b - 1, m):
            np.minimum.at(self.shift, self.at(self.codes, end), m - 1 - end)
        last = self.at(self.codes, m - 1)
        order = np.argsort(last, kind="stable")
        self.codes, self.texts, self.items = self.codes[order], [self.texts[i] for i in order], [self.items[i] for i in order]
        self.suffix, first = np.unique(last[order], return_index=True)
        self.first = np.append(first, len(order))

    def at(self, codes: np.ndarray, end: int) -> np.ndarray:
        return _block(codes[:, end - 1] if self.b == 2 else np.zeros(len(codes), np.uint64), codes[:, end], self.bits)

    def search(self, w: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """(index of the last word, pattern) of every occurrence within one text."""
        n, m = len(w.hash), self.m
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if n < m:
            return none
        bounds = np.linspace(m - 1, n, min(LANES, n - m + 1) + 1).astype(np.int64)
        at, stop, seen = bounds[:-1].copy(), bounds[1:], []
        while len(at):
            h = _block(w.hash[at - 1] if self.b == 2 else np.zeros(len(at), np.uint64), w.hash[at], self.bits)
            jump = self.shift[h].astype(np.int64)
            zero = jump == 0
            if zero.any():
                seen.append((at[zero], h[zero]))
                jump[zero] = 1
            at = at + jump
            live = at < stop
            at, stop = at[live], stop[live]
        if not seen:
            return none
        end, h = (np.concatenate(x) for x in zip(*seen, strict=True))
        k = np.minimum(np.searchsorted(self.suffix, h), len(self.suffix) - 1)
        ok = (self.suffix[k] == h) & (w.doc[end] == w.doc[end - m + 1])
        end, k = end[ok], k[ok]
        many = self.first[k + 1] - self.first[k]
        pattern = np.repeat(self.first[k], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        end = np.repeat(end, many)
        for j in range(m):
            ok = w.hash[end - (m - 1) + j] == self.codes[pattern, j]
            end, pattern = end[ok], pattern[ok]
        same = np.fromiter((w_text(w, e - m + 1, e) == self.texts[p] for e, p in zip(end, pattern, strict=True)), bool, len(end))
        return end[same], pattern[same]


def w_text(w: W.Words, a: int, b: int) -> bytes:
    """Words a..b of a text, with one space between."""
    return b" ".join(w.data[s:e].tobytes() for s, e in zip(w.start[a : b + 1], w.end[a : b + 1], strict=True))


def compile_items(ids: list, column: pa.Array, window: int) -> list[Length]:
    found: dict[int, dict[bytes, set]] = defaultdict(lambda: defaultdict(set))
    codes: dict[int, dict[bytes, np.ndarray]] = defaultdict(dict)
    for a, _, data, offsets in W.slices(column):
        w = W.words(data, offsets, W.ALNUM, lower=True)
        for i in range(len(offsets) - 1):
            s, e = w.first[i], w.first[i + 1]
            m = min(window, e - s)
            for k in range(s, e - m + 1 if m else s):
                text = w_text(w, k, k + m - 1)
                found[m][text].add("" if ids[a + i] is None else str(ids[a + i]))
                codes[m].setdefault(text, w.hash[k : k + m])
    return [Length(m, found[m], codes[m]) for m in sorted(found)]


def compile_benchmark(benchmark: DataFrame, where: str, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text", shard_items: int = SHARD_ITEMS) -> list[str]:
    """Compiles the items into shard files under where; returns their URIs."""
    items = benchmark.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    shards = max(1, -(-items.count() // shard_items))

    def run(batches):
        ids, texts = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            texts.append(batch.column(1))
        if ids:
            uri = f"{where}/shard-{hashlib.sha256(pickle.dumps(ids)).hexdigest()[:16]}"
            put(uri, pickle.dumps(compile_items(ids, pa.chunked_array(texts), window)))
            yield pa.RecordBatch.from_arrays([pa.array([uri])], ["uri"])

    return sorted(r["uri"] for r in items.repartition(shards).mapInArrow(tidy(run), "uri string").collect())


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated and hit_spans (word intervals, end exclusive)."""
    where = workspace(docs.sparkSession, "bench")
    uris = compile_benchmark(benchmark, where, window, item_col, item_text_col, shard_items)
    kept = [c for c in docs.columns if c not in (*RESULT, "hit_spans")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    added = [("n_words", "long"), ("n_hit", "long"), ("n_items", "long"), ("items_sha256", "string"), ("contaminated", "boolean"), ("hit_spans", "array<struct<start:int,end:int>>")]
    schema = T.StructType([*docs.schema, *T._parse_datatype_string(", ".join(f"{a} {b}" for a, b in added)).fields])
    none = hashlib.sha256(b"").hexdigest()

    def run(batches):
        cached: dict[str, list[Length]] = {}

        def load(uri):
            if uri not in cached:
                cached.clear()
                cached[uri] = pickle.loads(get(uri))
            return cached[uri]

        for batch in batches:
            out: list[list] = [[] for _ in added]
            for _, _, data, offsets in W.slices(batch.column(text_col)):
                w = W.words(data, offsets, W.ALNUM, lower=True)
                cover, items = np.zeros(len(w.hash) + 1, np.int32), defaultdict(set)
                for uri in uris:
                    for length in load(uri):
                        end, pattern = length.search(w)
                        np.add.at(cover, end - length.m + 1, 1)
                        np.add.at(cover, end + 1, -1)
                        for d, p in np.unique(np.stack([w.doc[end], pattern], 1), axis=0).tolist():
                            items[d].update(length.items[p])
                hit = np.concatenate([[0], (np.cumsum(cover[:-1]) > 0).astype(np.int64)])
                total = np.cumsum(hit)
                n_hit = total[w.first[1:]] - total[w.first[:-1]]
                spans: list = [[] for _ in range(len(offsets) - 1)]
                for d in np.flatnonzero(n_hit):
                    own = np.concatenate([[0], hit[1 + w.first[d] : 1 + w.first[d + 1]], [0]])
                    edge = np.flatnonzero(np.diff(own))
                    spans[d] = [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]
                out[0].append(np.diff(w.first))
                out[1].append(n_hit)
                for d in range(len(offsets) - 1):
                    got = sorted(items[d]) if d in items else []
                    out[2].append(len(got))
                    out[3].append(hashlib.sha256(",".join(got).encode()).hexdigest() if got else none)
                out[4].append(n_hit > 0)
                out[5] += spans
            arrays = [pa.array(np.concatenate(out[k]) if out[k] else [], t) for k, t in ((0, pa.int64()), (1, pa.int64()))]
            arrays += [pa.array(out[2], pa.int64()), pa.array(out[3], pa.string()), pa.array(np.concatenate(out[4]) if out[4] else [], pa.bool_()), pa.array(out[5], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*kept, *(a for a, _ in added)])

    return docs.mapInArrow(tidy(run), schema)
