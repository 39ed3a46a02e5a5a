"""Language ID by error-correcting output codes.

Every language has a codeword of +1 and -1; every bit has one binary classifier, naive
Bayes over hashed byte n-grams, which tells the languages with +1 from those with -1.
Up to seven languages use all distinct splits; more use random splits drawn until the
codewords lie far apart. A text's margins (mean log-odds over its n-grams, scaled) are
decoded by weighted loss: each bit weighs as well as it separates its training texts,
and the language with the least summed logistic loss wins. The score is the softmax of
the losses. A text is flagged as ambiguous when the two best lie within ``close`` of
each other.

Fitted on at most ``max_train`` rows with a language, those with the smallest hash of
their id; every row is scored. Null texts and texts without a letter give ``und`` with
score 0; so do all texts where nothing could be learnt. One language only: always
that one, with score 1. A repeated id teaches once, by the first of its texts; every row
of it is scored. Of languages with equal losses the first by name wins. Very long texts
are read whole, in slices. Input columns named like a result
column are replaced.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import _words as W
from weftline.llm._store import tidy

BITS, SIZES, MAX_TRAIN, SLICE = 16, (2, 3, 4), 6_000, 500_000
_KEEP = np.full(256, 32, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[65:91] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def codewords(k: int, seed: int = 11) -> np.ndarray:
    """k rows of +1 and -1."""
    if k <= 7:
        splits = [(1, *s) for s in itertools.product((1, -1), repeat=k - 1) if -1 in s]
        return np.array(splits, np.int8).T.reshape(k, -1)
    bits, best, gap = 2 * int(np.ceil(10 * np.log2(k))), None, -1
    rng = np.random.default_rng(seed)
    for _ in range(50):
        m = rng.choice(np.array([1, -1], np.int8), (k, bits))
        near = int(((bits - m.astype(int) @ m.T) // 2 + np.eye(k, dtype=int) * bits).min())
        if near > gap and (np.abs(m.sum(0)) < k).all():
            best, gap = m, near
    return best


def ngrams(data: np.ndarray, offsets: np.ndarray):
    """(slot, text) of the n-grams of every size."""
    b = _KEEP[data].astype(np.uint32)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for n in SIZES:
        if len(b) < n:
            continue
        m = len(b) - n + 1
        h = np.full(m, n, np.uint32)
        for k in range(n):
            h = h * np.uint32(0x01000193) ^ b[k : k + m]
        h *= np.uint32(0x9E3779B1)
        ok = (doc[:m] == doc[n - 1 :]) & ((b[:m] != 32) | (b[n - 1 :] != 32))
        yield (h[ok] >> np.uint32(32 - BITS)).astype(np.int64), doc[:m][ok]


def margins(column: pa.Array, weights: np.ndarray):
    """Per slice: first text, mean weights of its n-grams for each bit, number of n-grams, whether it has an ASCII letter, bytes and offsets."""
    for a, _, data, offsets in W.slices(column, SLICE):
        n = len(offsets) - 1
        total, count = np.zeros((n, weights.shape[1])), np.zeros(n, np.int64)
        for slot, doc in ngrams(data, offsets):
            c = np.bincount(doc, minlength=n)
            count += c
            first = np.concatenate([[0], np.cumsum(c)])[:-1]
            some = c > 0
            if some.any():
                total[some] += np.add.reduceat(weights[slot], first[some], axis=0)
        letter = np.concatenate([[0], np.cumsum((data | 32 >= 97) & (data | 32 <= 122))])
        yield a, total / np.maximum(count, 1)[:, None], count, letter[offsets[1:]] > letter[offsets[:-1]], data, offsets


class Model:
    def __init__(self, names: list[str], code: np.ndarray, weights: np.ndarray, scale: np.ndarray, trust: np.ndarray):
        self.names, self.code, self.weights, self.scale, self.trust = names, code, weights, scale, trust

    def losses(self, m: np.ndarray) -> np.ndarray:
        z = (m * self.scale)[:, None, :] * self.code[None, :, :]
        return (self.trust * np.logaddexp(0, -z)).sum(2)


def fit(column: pa.Array, langs: list[str]) -> Model:
    names = sorted(set(langs))
    k = len(names)
    code = codewords(k) if k > 1 else np.zeros((k, 0), np.int8)
    y = np.array([names.index(x) for x in langs], np.int64)
    counts = np.ones((k, 1 << BITS), np.float64)
    for a, _, data, offsets in W.slices(column, SLICE):
        for slot, doc in ngrams(data, offsets):
            np.add.at(counts, (y[a + doc], slot), 1.0)
    weights = np.zeros((1 << BITS, code.shape[1]), np.float32)
    for b in range(code.shape[1]):  # each bit knows two sides only
        one, two = counts[code[:, b] == 1], counts[code[:, b] == -1]
        one, two = (one / one.sum(1, keepdims=True)).mean(0), (two / two.sum(1, keepdims=True)).mean(0)
        weights[:, b] = np.log(one) - np.log(two)
    scale, trust = np.ones(code.shape[1]), np.ones(code.shape[1])
    if k > 1:
        m = np.concatenate([x for _, x, *_ in margins(column, weights)])
        side = code[y]
        scale = 4 / np.maximum(np.abs(m).mean(0), 1e-6)
        right = ((m * side > 0).mean(0) * len(y) + 1) / (len(y) + 2)
        trust = np.log(right / (1 - right)).clip(0.05)
        trust = trust / trust.sum() * 2
    return Model(names, code, weights, scale, trust)


def train(docs: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits on at most max_train rows of docs that have a language; the caller may hold rows out."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    order = F.crc32(F.concat(F.lit("lang/"), F.col("_id").cast("string")))
    keys = rows.select("_id").distinct().orderBy(order, "_id").limit(max_train)
    one = F.min(F.struct("_text", "_lang")).alias("_row")  # one row of a repeated id
    sample = rows.join(F.broadcast(keys), "_id").groupBy("_id").agg(one).select("_id", "_row.*").repartition(1).sortWithinPartitions(order, "_id")

    def run(batches):
        batches = list(batches)
        t = pa.Table.from_batches(batches) if batches else None
        model = fit(t.column("_text"), t.column("_lang").to_pylist()) if t else fit(pa.array([], pa.string()), [])
        yield pa.RecordBatch.from_arrays([pa.array([model.names], pa.list_(pa.string())), pa.array([model.weights.tobytes()]), pa.array([model.scale.tolist()], pa.list_(pa.float64())), pa.array([model.trust.tolist()], pa.list_(pa.float64()))], ["names", "weights", "scale", "trust"])

    r = sample.mapInArrow(tidy(run), "names array<string>, weights binary, scale array<double>, trust array<double>").first()
    if r is None:  # without rows there is no task
        return fit(pa.array([], pa.string()), [])
    names = list(r["names"])
    code = codewords(len(names)) if len(names) > 1 else np.zeros((len(names), 0), np.int8)
    return Model(names, code, np.frombuffer(r["weights"], np.float32).reshape(1 << BITS, -1), np.array(r["scale"]), np.array(r["trust"]))


def predict(docs: DataFrame, model: Model, text_col: str = "text", close: float = 0.1) -> DataFrame:
    """docs with lang_pred, score and ambiguous behind their own columns."""
    added = ["lang_pred", "score", "ambiguous"]
    kept = [c for c in docs.columns if c not in added]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^16 slots a bit, whatever the input
    schema = T.StructType([*docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])

    def run(batches):
        m = shared.value
        for batch in batches:
            lang, score, unsure = [], [], []
            for _, x, _, letter, data, offsets in margins(batch.column(text_col), m.weights):
                for i in np.flatnonzero(~letter):
                    letter[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
                if not m.names:
                    letter[:] = False
                    p = np.zeros((len(x), 1))
                else:
                    loss = m.losses(x)
                    p = np.exp((loss.min(1, keepdims=True) - loss) * m.code.shape[1] ** 0.5 * 2)
                    p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                top = np.sort(p, 1)
                lang += [m.names[b] if ok else "und" for b, ok in zip(best, letter, strict=True)]
                score += np.where(letter, top[:, -1], 0.0).tolist()
                unsure += (letter & (top[:, -1] - (top[:, -2] if top.shape[1] > 1 else 0) < close)).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], [*kept, *added])

    return docs.mapInArrow(tidy(run), schema)
