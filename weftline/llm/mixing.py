"""Mixing sources to target weights.

The words of a source form one stream, document after document, packed into blocks of
``block`` words. Every output shard of ``shard`` slots draws how many of its slots go
to each source: a multinomial over the shares that the sources still lack, so that
the totals come out exact. The j-th slot of a source is mapped through a pseudorandom
permutation of its block numbers (a keyed Feistel network with cycle walking, one key
for each source and pass), and blocks join slots by (source, block). The last slot of
a source is cut so that the source gives its target to the word. A pass visits every
block once, so no word is taken more than ceil(target / size) times, three at most.

Targets: sources by code point, null last, weigh 1, 2, 3, repeating, and share all
words; a target stops at ``ceiling`` times its source's size, and the excess is shared
again by weight.

The counts of all shards form a tree: a node splits what its sources lack between its two
halves by a draw of its own seed, so any task finds the counts of its shards from the
totals, and no list of shards exists. Positions are running sums over (source, bucket),
with a number of buckets that follows the rows, so that one source may hold any part of
the rows. The driver sees one row a source.

Nulls: a null text has no words; a null source is a source of its own; a null id is
kept. Empty texts and others without words are taken 0 times. A very long text reaches
many blocks and is taken block by block. Ties: rows of one source stand by id and a hash
of the text, so reruns agree. Repeated rows count once each; in ``mix_texts`` rows equal
in id, source and text are one text with the passes of all. Input columns may have any
other names. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import _words as W
from weftline.llm._store import materialise, running, tidy, workspace

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 256
SHARD = 4096
CEILING = 3


def targets(sizes: Sequence[int], weights: Sequence[float], ceiling: float = CEILING) -> list[float]:
    """Shares of sum(sizes) by weight, none above ceiling times its own size."""
    n, left = len(sizes), float(sum(sizes))
    out, open_ = [0.0] * n, set(range(n))
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if weights[i] * left / total > ceiling * sizes[i]}
        if not over:
            for i in open_:
                out[i] = weights[i] * left / total
            break
        for i in over:
            out[i] = float(ceiling * sizes[i])
        left = float(sum(sizes)) - sum(out)
        open_ -= over
    return out


def _feistel(n: int, key: int) -> tuple[np.uint64, np.uint64, list[np.uint64]]:
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    keys = [np.uint64(zlib.crc32(f"{key}/{r}".encode()) * 0x9E3779B1 & (1 << 63) - 1) for r in range(4)]
    return np.uint64(half), np.uint64((1 << half) - 1), keys


def _round(b: np.ndarray, k: np.uint64, mask: np.uint64) -> np.ndarray:
    f = (b + k) * np.uint64(0x9E3779B97F4A7C15)
    f ^= f >> np.uint64(29)
    f *= np.uint64(0xBF58476D1CE4E5B9)
    return (f >> np.uint64(32)) & mask


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0..n-1 at the points x."""
    h, mask, keys = _feistel(n, key)

    def once(v: np.ndarray) -> np.ndarray:
        a, b = v >> h, v & mask
        for k in keys:
            a, b = b, a ^ _round(b, k, mask)
        return (a << h) | b

    v = once(x.astype(np.uint64))
    while (out := v >= n).any():
        v[out] = once(v[out])
    return v.astype(np.int64)


def inverse(y: int, n: int, key: int) -> int:
    """The point whose image is y: the network run backwards, out of range and in again."""
    h, mask, keys = _feistel(n, key)
    v = np.array([y], np.uint64)
    while True:
        a, b = v >> h, v & mask
        for k in reversed(keys):
            a, b = b ^ _round(a, k, mask), a
        v = (a << h) | b
        if v[0] < n:
            return int(v[0])


def source_plan(size: int, take: int, block: int, seed: str) -> dict:
    """Slots of one source: full passes, slots of the last pass, words of the last slot."""
    if size == 0 or take == 0:
        return {"blocks": 0, "short": 0, "passes": 0, "slots": 0, "cut": 0, "key": 0}
    blocks = -(-size // block)
    short = size - (blocks - 1) * block
    passes, rest = divmod(take, size)
    key = zlib.crc32(seed.encode())
    slots, cut = 0, 0
    if rest:
        at = inverse(blocks - 1, blocks, key * 16 + passes)
        if rest <= at * block:
            slots = -(-rest // block)
            cut = rest - (slots - 1) * block
        elif rest <= at * block + short:
            slots, cut = at + 1, rest - at * block
        else:
            more = rest - at * block - short
            slots = at + 1 + -(-more // block)
            cut = more - (slots - at - 2) * block
    return {"blocks": blocks, "short": short, "passes": passes, "slots": passes * blocks + slots, "cut": cut, "key": key}


def part_of(lacking: np.ndarray, want: int, rng: np.random.Generator) -> np.ndarray:
    """want slots of those that the sources lack: multinomial draws, none above what its source lacks."""
    got = np.zeros_like(lacking)
    while (more := want - int(got.sum())) > 0:
        free = lacking - got
        got += np.minimum(rng.multinomial(more, free / free.sum()), free)
    return got


def draw(slots: Sequence[int], shard: int, seed: int, low: int = 0, high: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, slots by source before it, its slots by source) for the shards low..high-1 of the tree."""
    total = np.asarray(slots, np.int64)
    shards = -(-int(total.sum()) // shard)
    high = shards if high is None else min(high, shards)

    def walk(a: int, b: int, before: np.ndarray, lacking: np.ndarray):
        if b <= low or a >= high:
            return
        if b - a == 1:
            yield a, before, lacking
            return
        mid = (a + b) // 2
        left = part_of(lacking, (mid - a) * shard, np.random.default_rng([seed, a, b]))  # only the last shard is short
        yield from walk(a, mid, before, left)
        yield from walk(mid, b, before + left, lacking - left)

    if shards:
        yield from walk(0, shards, np.zeros_like(total), total)


class Mix:
    """placed: documents with source number, size and place in the stream; sources: the plan; slots: the mix itself."""

    def __init__(self, spark: SparkSession, docs: DataFrame, where: str, block: int = BLOCK, shard: int = SHARD, ceiling: int = CEILING, seed: int = 7, rows_a_bucket: int = 2_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
        self.block = block
        sized = docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("h"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        )
        sized = materialise(sized, where, "sized")
        by = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        by = sorted(by, key=lambda r: (r["source"] is None, r["source"] or ""))
        sizes = [int(r["size"]) for r in by]
        goal = targets(sizes, [1 + i % 3 for i in range(len(by))], ceiling)
        plan = [{"sid": i, "source": r["source"], "source_size": sizes[i], "target": goal[i]} | source_plan(sizes[i], min(ceiling * sizes[i], int(goal[i] + 0.5)), block, f"{seed}/{r['source']!r}") for i, r in enumerate(by)]
        self.plan = plan
        kinds = [("sid", pa.int64()), ("source", pa.string()), ("source_size", pa.int64()), ("target", pa.float64())]
        self.sources = spark.createDataFrame(pa.table({k: pa.array([p[k] for p in plan], t) for k, t in kinds}))
        buckets = max(1, -(-sum(r["n"] for r in by) // rows_a_bucket))
        b = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h"), F.lit(buckets)))
        order = Window.partitionBy("source", "bucket").orderBy("doc_id", "h")
        local = b.withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        base = running(b.groupBy("source", "bucket").agg(F.sum("size").alias("bs")), "bucket", {"base": "bs"}, "source")
        base = base.select(F.col("source").alias("s2"), F.col("bucket").alias("b2"), "base")
        src = self.sources.select(F.col("source").alias("s3"), "sid", "source_size", "target")
        placed = (
            local.join(base, local["source"].eqNullSafe(base["s2"]) & (local["bucket"] == base["b2"]))
            .join(src, F.col("source").eqNullSafe(F.col("s3")))
            .select("doc_id", "h", "source", "sid", "size", "source_size", "target", (F.col("base") + F.col("end") - F.col("size")).alias("start"))
        )
        self.placed = materialise(placed, where, "placed")
        lacking = [p["slots"] for p in plan]
        shards = -(-sum(lacking) // shard)

        def slots(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                low, high = batch.column(0)[0].as_py(), batch.column(0)[-1].as_py() + 1
                for k, first, count in draw(lacking, shard, seed, low, high):
                    o = [np.arange(f, f + c) for f, c in zip(first, count, strict=True)]
                    sid = np.repeat(np.arange(len(o)), count)
                    n = [_slots_of(plan[i], x, block) for i, x in enumerate(o)]
                    turn, at, words = (np.concatenate([x[j] for x in n]) for j in range(3))
                    pos = np.random.default_rng([seed, k]).permutation(len(sid))
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.full(len(sid), k), pos, sid, turn, at, words)], ["shard", "slot", "sid", "pass", "block", "words"])

        tasks = min(max(1, shards), max(2 * spark.sparkContext.defaultParallelism, -(-shards // 1024)))
        self.slots = spark.range(0, shards, 1, tasks).mapInArrow(tidy(slots), "shard long, slot long, sid long, pass long, block long, words long")

    def pieces(self) -> DataFrame:
        """(document, block it reaches, [x, y) of that block that is its own)."""
        b = F.lit(self.block)
        d = self.placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {self.block}"), F.expr(f"(start + size - 1) div {self.block}"))))
        return d.withColumn("x", F.greatest(F.col("start") - F.col("block") * b, F.lit(0))).withColumn("y", F.least(F.col("start") + F.col("size") - F.col("block") * b, b))

    def taken(self) -> DataFrame:
        """Every document with the words that the mix takes of it, repeats counted."""
        per = self.slots.groupBy("sid", "block").agg(F.sort_array(F.collect_list("words")).alias("cuts"))  # as many as passes
        own = self.pieces().join(per.hint("merge"), ["sid", "block"]).select("doc_id", "h", "sid", "start", F.aggregate("cuts", F.lit(0).cast("long"), lambda s, c: s + F.greatest(F.lit(0), F.least(F.col("y"), c) - F.col("x"))).alias("t"))
        key = ["sid", "start"]  # unique among documents with words
        sums = own.groupBy(*key).agg(F.sum("t").alias("taken"))
        some = self.placed.where("size > 0").join(sums, key, "left")
        cols = ["doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")]
        return some.select(*cols).unionAll(self.placed.where("size = 0").withColumn("taken", F.lit(0)).select(*cols))


def _slots_of(p: dict, o: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pass, block and words of the slots numbered o of one source."""
    if not len(o):
        return (o, o, o)
    turn, j = o // p["blocks"], o % p["blocks"]
    at = np.empty_like(o)
    for t in np.unique(turn):
        at[turn == t] = permute(j[turn == t], p["blocks"], p["key"] * 16 + int(t))
    words = np.where(at == p["blocks"] - 1, p["short"], block)
    if p["cut"]:
        words[o == p["slots"] - 1] = p["cut"]
    return turn, at, words


def mix_texts(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus as documents: for every pass that takes words of a document one row
    with those words of its text, in its own columns. A document taken whole keeps its text
    to the byte; else each run of words taken is cut from the text as it stands and the runs
    are joined by one space. n_chars, where there is one, is set anew.
    """
    where = workspace(spark, "mix")
    m = Mix(spark, docs, where, **options)
    hit = m.pieces().join(m.slots.hint("merge"), ["sid", "block"]).where("words > x")
    off = F.col("block") * m.block - F.col("start")
    hit = hit.select("doc_id", "source", "h", "sid", "start", "size", "pass", (F.col("x") + off).alias("a"), (F.least("y", "words") + off).alias("b"))
    rows = hit.groupBy("doc_id", "source", "h", "size", "sid", "start", "pass").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs"))
    rows = rows.groupBy("doc_id", "source", "h", "size").agg(F.collect_list("runs").alias("all_runs"))
    texts = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("i"), F.col("source").alias("s"), F.xxhash64("text").alias("k")).dropDuplicates(["i", "s", "k"])
    both = texts.join(rows, F.col("i").eqNullSafe(F.col("doc_id")) & F.col("s").eqNullSafe(F.col("source")) & (F.col("k") == F.col("h"))).select("row", rows["size"].alias("size"), "all_runs")
    names, out = docs.columns, T.StructType([T.StructField(f.name, T.LongType() if f.name == "n_chars" else f.dataType) for f in docs.schema])

    def cut(batches):
        for batch in batches:
            fields = dict(zip(names, batch.column("row").flatten(), strict=True))
            sizes, all_runs = batch.column("size").to_pylist(), batch.column("all_runs")
            for low, high, data, offsets in W.slices(fields["text"]):
                w = W.words(data, offsets, W.NOT_BLANK, hashed=False)
                keep, texts_out = [], []
                for i in range(low, high):
                    first = w.first[i - low]
                    for runs in all_runs[i].as_py():
                        keep.append(i)
                        if sum(r["b"] - r["a"] for r in runs) == sizes[i]:
                            texts_out.append(data[offsets[i - low] : offsets[i - low + 1]].tobytes().decode("utf-8", "replace"))
                            continue
                        joined: list[list[int]] = []
                        for r in runs:
                            if joined and joined[-1][1] == r["a"]:
                                joined[-1][1] = r["b"]
                            else:
                                joined.append([r["a"], r["b"]])
                        texts_out.append(b" ".join(data[w.start[first + a] : w.end[first + b - 1]].tobytes() for a, b in joined).decode("utf-8", "replace"))
                cols = {n: c.take(pa.array(keep, pa.int64())) for n, c in fields.items()} | {"text": pa.array(texts_out, fields["text"].type)}
                if "n_chars" in cols:
                    cols["n_chars"] = pa.array([len(x) for x in texts_out], pa.int64())
                yield pa.RecordBatch.from_arrays(list(cols.values()), names)

    return both.mapInArrow(tidy(cut), out)
