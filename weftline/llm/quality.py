"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader.

A text's features are its runs of letters or digits and its runs of other visible
characters, alone and in pairs, and the pattern of a word that returns at once or
after one other, hashed into 2^bits slots; a feature weighs the square
root of its count, and the vector has length one. Training visits each example in
turn and updates only the slots that it holds (FTRL-proximal, so most weights are
exactly zero); a score is the logistic function of a sparse dot product.

Training is fitted on at most ``max_train`` labelled rows, those with the smallest
hash of their id, in one task that holds only them. All rows are scored.

Null and empty texts have no features and get the score of the bias alone. Without
labelled rows, or with one class only, every score is the smoothed share of label 1.
Labels repeated for an id count once, by their maximum; null labels are left out. A
repeated id teaches once, by the first of its texts (null before all); every row of it is
scored. Very long texts are read whole, in slices. Columns named like a result column are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import _words as W
from weftline.llm._store import tidy

BITS = 20
MAX_TRAIN = 6_000


def features(column: pa.Array, bits: int = BITS) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice: index of its first text, offsets by text into slots and values."""
    for a, b, data, offsets in W.slices(column):
        w = W.words(data, offsets, W.RUNS)
        h2, d2 = W.grams(w, 2)
        hashes, docs = [w.hash, h2], [w.doc, d2]
        for k in (1, 2):  # n-grams of one word over and over, whichever it is
            again = w.doc[k:][(w.hash[k:] == w.hash[:-k]) & (w.doc[k:] == w.doc[:-k])]
            docs.append(again)
            hashes.append(W.mix(np.full(len(again), k, np.uint64)))
        slot = np.concatenate(hashes) >> np.uint64(64 - bits)
        key = (np.concatenate(docs).astype(np.uint64) << np.uint64(bits)) | slot
        key.sort()
        new = np.ones(len(key), bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(key)))
        key = key[at]
        doc = (key >> np.uint64(bits)).astype(np.int64)
        first = np.searchsorted(doc, np.arange(b - a + 1))
        total = np.bincount(doc, count, minlength=b - a)
        yield a, first, (key & np.uint64((1 << bits) - 1)).astype(np.int64), np.sqrt(count / np.maximum(total, 1)[doc])


def fit(column: pa.Array, labels: np.ndarray, bits: int = BITS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, epochs: int = 4) -> tuple[np.ndarray, float]:
    """Weights and bias."""
    n1 = int(labels.sum())
    weights = np.zeros(1 << bits, np.float32)
    if n1 in (0, len(labels)):
        return weights, float(np.log((n1 + 1) / (len(labels) - n1 + 1)))
    rows = []
    for _, first, slot, value in features(column, bits):
        rows += [(slot[s:e].astype(np.int32), value[s:e].astype(np.float32)) for s, e in zip(first[:-1], first[1:], strict=True)]
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias = bn = 0.0
    balance = np.array([0.5 * len(labels) / (len(labels) - n1), 0.5 * len(labels) / n1])
    for _ in range(epochs):
        for (i, x), y in zip(rows, labels, strict=True):
            zi, ni = z[i], n[i]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(w @ x + bias, -35, 35)))
            g = (p - y) * balance[int(y)]
            gi = g * x
            root = np.sqrt(ni + gi * gi)
            z[i] = zi + gi - (root - np.sqrt(ni)) / alpha * w
            n[i] = ni + gi * gi
            bn += g * g
            bias -= 0.1 * g / (1 + np.sqrt(bn))
    live = np.abs(z) > l1
    weights[live] = (-(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))[live]
    return weights, float(bias)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, float]:
    """Fits on at most max_train labelled rows of docs. labels(id, label): may be restricted by the caller."""
    chosen = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y is not null")
        .groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.crc32(F.col("_id").cast("string")), "_id").limit(max_train)
    )
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text")).repartition(1).sortWithinPartitions(F.crc32(F.col("_id").cast("string")), "_id")

    def run(batches):
        parts = pa.Table.from_batches(batches, schema=pa.schema([("_id", pa.int64()), ("_text", pa.string()), ("_y", pa.int32())])) if (batches := list(batches)) else None
        text = parts.column("_text") if parts else pa.chunked_array([[]], pa.string())
        w, b = fit(text, parts.column("_y").to_numpy() if parts else np.zeros(0, np.int64), bits)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32).tobytes()]), pa.array([w[at].tobytes()]), pa.array([b])], ["slots", "weights", "bias"])

    row = sample.select("_id", "_text", "_y").mapInArrow(tidy(run), "slots binary, weights binary, bias double").first()
    weights = np.zeros(1 << bits, np.float32)
    if row is None:  # without rows there is no task
        return weights, 0.0
    weights[np.frombuffer(row["slots"], np.int32)] = np.frombuffer(row["weights"], np.float32)
    return weights, row["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", bits: int = BITS) -> DataFrame:
    """docs with the columns score and predicted behind their own (replacing columns of those names)."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 bytes times 2^bits, whatever the input
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*docs.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        weights, bias = shared.value
        for batch in batches:
            out = np.full(batch.num_rows, bias)
            for a, first, slot, value in features(batch.column(text_col), bits):
                total = np.concatenate([[0.0], np.cumsum(weights[slot] * value)])
                out[a : a + len(first) - 1] += total[first[1:]] - total[first[:-1]]
            p = 1 / (1 + np.exp(-np.clip(out, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*kept, "score", "predicted"])

    return docs.mapInArrow(tidy(run), schema)
