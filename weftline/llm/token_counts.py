"""Word-piece lengths by a linear longest-match automaton.

A vocabulary is laid out as a trie. Every node has a failure link and the number of
pieces that are popped when the walk takes it, both found once in breadth-first order:
a node that is itself a piece pops one piece and falls back to the start for
continuing pieces; any other node takes its parent's pops and link and walks on until
its own last symbol fits. A word is then read symbol by symbol, each symbol costing
constant time on average, and the popped counts add up to the number of greedy
longest-match pieces, which are never built.

Words: the text lower-cased; runs of word characters, and every other visible
character alone. Symbols are the bytes of a word; where the vocabulary marks word ends
a word's last byte is a symbol of its own, so that a piece with the mark matches there
alone and no other piece takes that byte. A word that cannot be split counts as one piece
(unknown). Counts by word are kept in a bounded table for each worker.

Null and empty texts have no words and no pieces. Very long texts and words are read
whole. Ties do not arise: the longest match is one. Repeated rows are counted each.
Input columns named like a result column are replaced.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm._store import KEPT, tidy

WORDS = re.compile(r"\w+|[^\w\s]")
MEMO = 1_000_000


def byte_symbols() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: visible Latin-1 bytes as themselves, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


LAST = 256  # what a word's last byte has more than the same byte within


def read_vocabulary(definition: str, end_mark: str = "</w>") -> tuple[list[tuple[int, ...]], list[tuple[int, ...]], bool]:
    """Initial and continuing pieces of a tokenizers file, and whether words' last bytes are marked. Word-piece: by its
    prefix. Byte-level: every piece may stand anywhere; with marks of word ends those pieces only at the end."""
    model = json.loads(definition)["model"]
    vocabulary = model["vocab"] if isinstance(model["vocab"], dict) else {p: i for i, (p, _) in enumerate(model["vocab"])}
    if model.get("type") == "WordPiece":
        prefix = model.get("continuing_subword_prefix", "##")
        initial = [tuple(p.encode()) for p in vocabulary if not p.startswith(prefix)]
        return initial, [tuple(p[len(prefix) :].encode()) for p in vocabulary if p.startswith(prefix) and p != prefix], False
    table = byte_symbols()
    out = []
    for p in vocabulary:
        body = p.removesuffix(end_mark)
        if body and all(c in table for c in body):
            b = [table[c] for c in body]
            out.append(tuple(b if body == p else [*b[:-1], b[-1] + LAST]))
    return out, out, any(p[-1] >= LAST for p in out)


class Automaton:
    """child: (node * 512 + symbol) to node; fail: failure links, -1 for none; pops: pieces popped by the link.

    With ended, a word's last byte is read as that byte plus LAST.
    """

    def __init__(self, initial: Iterable[tuple[int, ...]], continuing: Iterable[tuple[int, ...]], ended: bool = False):
        self.ended = ended
        self.child: dict[int, int] = {}
        self.fail, self.pops, accept = [-1, -1], [0, 0], [False, False]
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                u = root
                for s in piece:
                    key = u * 512 + s
                    if key not in self.child:
                        self.child[key] = len(self.fail)
                        self.fail.append(-1)
                        self.pops.append(0)
                        accept.append(False)
                    u = self.child[key]
                accept[u] |= u > 1
        below: dict[int, list[tuple[int, int]]] = {}
        for key, v in self.child.items():
            below.setdefault(key // 512, []).append((key % 512, v))
        queue = deque((0, 1))
        while queue:
            u = queue.popleft()
            for s, v in below.get(u, []):
                if accept[v]:
                    self.fail[v], self.pops[v] = 1, 1
                else:
                    z, n = self.fail[u], self.pops[u]
                    while z != -1 and z * 512 + s not in self.child:
                        n, z = n + self.pops[z], self.fail[z]
                    if z != -1:
                        self.fail[v], self.pops[v] = self.child[z * 512 + s], n
                queue.append(v)

    def count(self, word: bytes) -> int:
        """Greedy pieces of a word; 1 if it has no split."""
        child, fail, pops = self.child, self.fail, self.pops
        u = total = 0
        for s in [*word[:-1], word[-1] + LAST] if self.ended and word else word:
            while (v := child.get(u * 512 + s)) is None:
                if fail[u] == -1:
                    return 1
                total += pops[u]
                u = fail[u]
            u = v
        while u > 1:
            if fail[u] == -1:
                return 1
            total += pops[u]
            u = fail[u]
        return total


_automata: dict[int, tuple[Automaton, dict[str, int]]] = KEPT.setdefault("token_counts", {})


def _automaton(definition: str) -> tuple[Automaton, dict[str, int]]:
    key = zlib.crc32(definition.encode())
    if key not in _automata:
        _automata.clear()
        _automata[key] = Automaton(*read_vocabulary(definition)), {}
    return _automata[key]


def token_counts(docs: DataFrame, definition: str, text_col: str = "text") -> DataFrame:
    """docs with n_words and n_pieces behind their own columns. definition: the text of a tokenizers file."""
    kept = [c for c in docs.columns if c not in ("n_words", "n_pieces")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    shared = docs.sparkSession.sparkContext.broadcast(definition)  # the vocabulary's file, whatever the input
    schema = T.StructType([*docs.schema, T.StructField("n_words", T.LongType()), T.StructField("n_pieces", T.LongType())])

    def run(batches):
        automaton, memo = _automaton(shared.value)
        for batch in batches:
            n_words, n_pieces = [], []
            for text in batch.column(text_col):
                found = WORDS.findall((text.as_py() or "").lower())
                if len(memo) > MEMO:
                    memo.clear()
                for w in set(found):
                    if w not in memo:
                        memo[w] = automaton.count(w.encode("utf-8", "surrogatepass"))
                n_words.append(len(found))
                n_pieces.append(sum(map(memo.__getitem__, found)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_words, pa.int64()), pa.array(n_pieces, pa.int64())], [*kept, "n_words", "n_pieces"])

    return docs.mapInArrow(tidy(run, "token_counts"), schema)
