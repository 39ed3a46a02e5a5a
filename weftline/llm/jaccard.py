"""N-gram Jaccard join by vertical partitioning.

The space of n-gram hashes is cut into fragments (hash ranges) whose number follows
the input. Every chunk of documents sends each fragment its distinct hashes that fall
there, each once with the number of its documents, so an n-gram that any share of all
documents holds is one entry a chunk. A fragment sums the numbers and answers the chunks
with the n-grams that two or more distinct texts hold; only such n-grams can be
shared. The global order puts rare n-grams first. A document whose prefix (its first
n - ceil(t n) + 1 n-grams in that order) holds no shared n-gram has no partner and is
done. The others meet in buckets by prefix n-gram, under length and position filters.
The overlap of a pair is counted for each fragment group apart and summed per pair.

Texts with equal sets are one vertex, named by a 64-bit fingerprint of the set. The
result is the partition into components, so pairs inside one component need no
count: two greedy rounds count each vertex's most promising partners, and the last
round counts all remaining pairs that lie in different components. Thus a group of
thousands of near copies costs a few pairs for each member, and no link between
components is lost. In the last round a bucket is cut into classes of length, a vertex
goes only to classes whose shortest member it could still match, and pairs of
large classes are dealt over several tasks.

N-grams are compared by 52 bits of their hash, sets by 64. Two sets that differ by
fingerprint but share every n-gram by hash are not linked: at least one of those is a
chance meeting of hashes (which for sets of one n-gram would else be a link).

Words: A-Z lower-cased, runs between blanks. Sets: distinct n-grams of ``width``
words; fewer words: the whole sequence; null, empty or no words: no set, linked with
nothing. A component is named by its least id (nulls last); ties between rows of one id
are broken by a hash of the text. Repeated ids and rows keep a row each. A very long text
is a chunk of its own. Only the id and text columns are read, whatever others are called. An
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import _words as W
from weftline.llm._components import components
from weftline.llm._store import drop, materialise, tidy, workspace

WIDTH, PERCENT = 5, 75
FRAGMENT = 2_000_000
CHUNK_BYTES, CHUNK_DOCS = 4_000_000, 60_000
GROUPS = 4
BITS, COARSE = np.uint64(52), np.uint64(20)  # of a hash, and of those the ones that no fragment's border needs
SEVERAL = 65_535  # in place of a document: the chunk itself knows which hold the n-gram
STEP = 1.08  # between classes of length
MEETING = 2_000  # rows of a class that one task meets with another's
SALTS = 16


def sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes and their texts, sorted by text and hash; size and fingerprint of each text's set."""
    w = W.words(data, offsets, W.NOT_BLANK, lower=True)
    n_docs = len(offsets) - 1
    h, d = W.grams(w, width)
    length = np.diff(w.first)
    more = []
    for k in range(1, width):
        if (length == k).any():
            hk, dk = W.grams(w, k)
            own = length[dk] == k
            more.append((hk[own], dk[own]))
    if more:
        h, d = np.concatenate([h, *(x for x, _ in more)]), np.concatenate([d, *(x for _, x in more)])
    order = np.argsort(h)
    order = order[np.argsort(d[order].astype(np.uint32) if n_docs > 1 << 16 else d[order].astype(np.uint16), kind="stable")]
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    size = np.bincount(d, minlength=n_docs)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(h ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    at = np.concatenate([[0], np.cumsum(size)])
    sig = W.mix(total[at[1:]] - total[at[:-1]] + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return h, d, size, sig.view(np.int64)


def planes(a: np.ndarray, n: int) -> bytes:
    """The low n bytes of each value, byte by byte: high bytes of small values compress well."""
    return a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes()


def unplanes(b: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8).reshape(n, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :n] = raw.T
    return out.view("<u8").ravel()


ROW = "key long, chunk long, hashes binary, docs binary, codes binary, ids array<long>, marks array<long>, sizes array<long>, sigs array<long>"
NAMES = ["key", "chunk", "hashes", "docs", "codes", "ids", "marks", "sizes", "sigs"]


def _row(key: int, chunk: int, hashes=None, docs=None, codes=None, ids=None, marks=None, sizes=None, sigs=None) -> pa.RecordBatch:
    lists = [pa.array([None], pa.list_(pa.int64())) if v is None else pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (ids, marks, sizes, sigs)]
    return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([chunk]), *(pa.array([v], pa.binary()) for v in (hashes, docs, codes)), *lists], NAMES)


def _fragment_of(h: np.ndarray, fragments: int) -> np.ndarray:
    return ((h >> COARSE) * np.uint64(fragments) >> (BITS - COARSE)).astype(np.int64)


def _border(f: int, fragments: int) -> np.uint64:
    """No hash of fragment f is less."""
    return np.uint64(((f << int(BITS - COARSE)) // fragments) << int(COARSE))


def _deltas(h: np.ndarray, border: np.uint64) -> bytes:
    return planes(np.diff(h, prepend=border), 7)


def _undeltas(b: bytes, border: np.uint64) -> np.ndarray:
    return np.cumsum(unplanes(b, 7), dtype=np.uint64) + border


def _scatter(width: int, fragments: int):
    """Documents to rows by (fragment, chunk), and one row a chunk with its documents and the n-grams that several of them hold."""

    def close(chunk, ids, marks, held):
        size, sig = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
        base = np.cumsum([0, *(len(x[2]) for x in held)])
        h, d = np.concatenate([x[0] for x in held]) >> (np.uint64(64) - BITS), np.concatenate([x[1] + b for x, b in zip(held, base, strict=False)])
        first = np.zeros(len(sig), bool)
        first[np.unique(sig, return_index=True)[1]] = True  # one of each set is enough
        live = first[d]
        h, d = h[live], d[live]
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        many = np.diff(np.append(at, len(h)))
        u, doc = h[at], np.where(many > 1, SEVERAL, d[at])
        f = _fragment_of(u, fragments)
        cut = np.flatnonzero(np.diff(f)) + 1
        for a, b in zip([0, *cut], [*cut, len(f)], strict=True):
            if b > a:
                own = many[a:b]
                yield _row(int(f[a]), chunk, _deltas(u[a:b], _border(int(f[a]), fragments)), planes(doc[a:b], 2), planes(own[own > 1], 2))
        several = np.repeat(many > 1, many)
        own = pa.concat_arrays(ids), pa.concat_arrays(marks), pa.array(size, pa.int64()), pa.array(sig, pa.int64())
        yield _row(-1 - chunk, chunk, _deltas(u[many > 1], np.uint64(0)), planes(d[several], 2), planes(many[many > 1], 2), *own)

    def run(batches):
        base, k = TaskContext.get().partitionId() << 24, 0
        ids, marks, held, size, n = [], [], [], 0, 0
        for batch in batches:
            for a, b, data, offsets in W.slices(batch.column(1)):
                for lo in range(0, b - a, CHUNK_DOCS):
                    hi = min(b - a, lo + CHUNK_DOCS)
                    if held and (size + offsets[hi] - offsets[lo] > CHUNK_BYTES or n + hi - lo > CHUNK_DOCS):
                        yield from close(base + k, ids, marks, held)
                        ids, marks, held, size, n, k = [], [], [], 0, 0, k + 1
                    ids.append(batch.column(0).slice(a + lo, hi - lo))
                    marks.append(batch.column(2).slice(a + lo, hi - lo))
                    held.append(sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width))
                    size += offsets[hi] - offsets[lo]
                    n += hi - lo
        if held:
            yield from close(base + k, ids, marks, held)

    return run


def _by_key(batches, column: int):
    """Rows with the same value in a column, of input sorted by it."""
    key, rows = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            row = [batch.column(k)[i].as_py() if k < 5 else batch.column(k)[i].values for k in range(len(NAMES))]
            if rows and row[column] != key:
                yield key, rows
                rows = []
            key = row[column]
            rows.append(row)
    if rows:
        yield key, rows


def _count(fragments: int):
    """Of each fragment: the n-grams that several documents hold, with the logarithm of their number, back to each chunk."""

    def run(batches):
        for key, rows in _by_key(batches, 0):
            if key < 0:
                yield from (_row(*r) for r in rows)
                continue
            h = [_undeltas(r[2], _border(key, fragments)) for r in rows]
            weight = []
            for r in rows:
                w = np.ones(len(r[3]) // 2, np.uint32)
                w[unplanes(r[3], 2) == SEVERAL] = unplanes(r[4], 2)
                weight.append(w)
            every, weight = np.concatenate(h), np.concatenate(weight)
            order = np.argsort(every)
            every, weight = every[order], weight[order]
            edge = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            many = np.add.reduceat(weight, edge, dtype=np.int64)
            shared = many > 1
            keys, code = every[edge[shared]], np.minimum(255, 8 * np.log2(many[shared])).astype(np.uint8)
            if not len(keys):
                continue
            for r, own in zip(rows, h, strict=True):
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                hit = keys[at] == own
                if hit.any():
                    yield _row(key, r[1], _deltas(own[hit], _border(key, fragments)), planes(unplanes(r[3], 2)[hit], 2), code[at[hit]].tobytes())

    return run


def _gather(percent: int, fragments: int):
    """Of each chunk: a row a distinct set with its documents, and the shared n-grams in global order if it may have a partner."""

    def run(batches):
        for _, rows in _by_key(batches, 1):
            own = next(r for r in rows if r[0] < 0)
            n, sig, parts = own[7].to_numpy(), own[8].to_numpy(), [r for r in rows if r[0] >= 0]
            if parts:
                h = np.concatenate([_undeltas(r[2], _border(r[0], fragments)) for r in parts])
                d = np.concatenate([unplanes(r[3], 2) for r in parts]).astype(np.int64)
                c = np.concatenate([np.frombuffer(r[4], np.uint8) for r in parts])
                one = d != SEVERAL
                several, docs, many = _undeltas(own[2], np.uint64(0)), unplanes(own[3], 2).astype(np.int64), unplanes(own[4], 2).astype(np.int64)
                at = np.searchsorted(h[~one], several, sorter=(order := np.argsort(h[~one])))
                code = c[~one][order[at]] if len(several) else np.zeros(0, np.uint8)
                h, d, c = np.concatenate([h[one], np.repeat(several, many)]), np.concatenate([d[one], docs]), np.concatenate([c[one], np.repeat(code, many)])
                order = np.lexsort((h, c, d))
                h, d = h[order], d[order]
            else:
                h, d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            _, first, of = np.unique(sig, return_index=True, return_inverse=True)
            k = np.bincount(d, minlength=len(n))
            at = np.concatenate([[0], np.cumsum(k)])
            prefix = n - (-(-percent * n // 100)) + 1
            live = (n > 0) & (n - k < prefix) & (k > 0)
            order = np.argsort(of, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(first)))])
            for a in range(0, len(first), 2000):
                f = first[a : a + 2000]
                b = a + len(f)
                grams = [h[at[i] : at[i + 1]].astype(np.int64) if live[i] else None for i in f]
                take = pa.array(order[ends[a] : ends[b]])
                lists = [pa.ListArray.from_arrays(pa.array(ends[a : b + 1] - ends[a], pa.int32()), own[x].take(take)) for x in (5, 6)]
                yield pa.RecordBatch.from_arrays([pa.array(sig[f], pa.int64()), pa.array(n[f]), pa.array((n - k)[f]), pa.array(prefix[f]), pa.array(grams, pa.list_(pa.int64())), *lists], ["sig", "n", "alone", "prefix", "grams", "ids", "marks"])

    return run


def _verified(pairs: DataFrame, segments: DataFrame, where: str, name: str, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold: partial overlaps by fragment group, summed per pair."""
    left = segments.select(F.col("sig").alias("a"), "g", F.col("n").alias("na"), F.col("part").alias("pa"))
    right = segments.select(F.col("sig").alias("b"), "g", F.col("n").alias("nb"), F.col("part").alias("pb"))
    counted = pairs.join(left, "a").join(right, ["b", "g"]).select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).alias("o"))
    total = counted.groupBy("a", "b").agg(F.sum("o").alias("o"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    chance = (F.col("o") == F.col("na")) & (F.col("o") == F.col("nb"))  # equal sets would be one vertex
    return materialise(total.where((F.col("o") * 100 >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("o"))) & ~chance).select("a", "b"), where, name)


def _all_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) of rows(gram, sig, n, pos, root) that meet in an n-gram, lie in different components, and pass the length and position filters."""
    near = int(np.ceil(np.log(100 / percent) / np.log(STEP)))
    rows = rows.withColumn("c", F.floor(F.log("n") / F.log(F.lit(STEP))))
    classes = rows.groupBy("gram", "c").agg(F.min("n").alias("least"), F.count("*").alias("rows"))
    classes = classes.groupBy("gram").agg(F.collect_list(F.struct("c", "least", "rows")).alias("classes"))  # a few hundred at most: logarithms of lengths
    own = F.element_at(F.filter("classes", lambda x: x["c"] == F.col("c")), 1)["rows"]
    enough = lambda x: (F.abs(x["c"] - F.col("c")) <= near) & ((F.col("n") - F.col("pos")) * (100 + percent) >= (F.col("n") + x["least"]) * percent)
    sent = rows.join(classes, "gram").select("gram", "sig", "n", "pos", "root", "c", own.alias("own"), F.explode(F.filter("classes", enough)).alias("x"))
    deals = F.ceil(F.greatest("own", "x.rows") / MEETING)
    sent = sent.select("gram", "sig", "n", "pos", "root", F.least("c", "x.c").alias("low"), F.greatest("c", "x.c").alias("high"), (F.col("c") <= F.col("x.c")).alias("is_low"), (F.col("c") >= F.col("x.c")).alias("is_high"), deals.alias("deals"))
    key = ["gram", "low", "high", "deal"]
    x = sent.where("is_low").select(*key[:3], F.pmod("sig", "deals").alias("deal"), F.col("sig").alias("a"), F.col("n").alias("na"), F.col("pos").alias("i"), F.col("root").alias("ra"))
    y = sent.where("is_high").select(*key[:3], F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal"), F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("j"), F.col("root").alias("rb"))
    overlap = F.least(F.col("na") - F.col("i"), F.col("nb") - F.col("j"))
    once = (F.col("low") != F.col("high")) | (F.col("a") < F.col("b"))
    fits = once & (F.col("ra") != F.col("rb")) & (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent) & (overlap * (100 + percent) >= (F.col("na") + F.col("nb")) * percent)
    return x.hint("merge").join(y, key).where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs."""
    return jaccard_rows(docs, width, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def jaccard_rows(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, n_shingles, component_id, kept) for every row of docs. mark: xxhash64 of the text; kept: no row of the component comes before by id (nulls last) and mark."""
    spark = docs.sparkSession
    where = workspace(spark, "jaccard")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = max(8, size // 6 // FRAGMENT)
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(slots, fragments)
    scattered = docs.mapInArrow(tidy(_scatter(width, fragments)), ROW)
    counted = scattered.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(tidy(_count(fragments)), ROW)
    listed = counted.repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(tidy(_gather(percent, fragments)), "sig long, n long, alone long, prefix long, grams array<long>, ids array<long>, marks array<long>")
    listed = materialise(listed, where, "listed")
    vertices = materialise(listed.where("grams is not null").select("sig", "n", "alone", "prefix", "grams").dropDuplicates(["sig"]), where, "vertices")
    group = F.transform(F.sequence(F.lit(0), F.lit(GROUPS - 1)), lambda g: F.struct(g.alias("g"), F.filter("grams", lambda x: F.pmod(F.shiftright(x, 7), F.lit(GROUPS)) == g).alias("part")))
    segments = vertices.select("sig", "n", F.inline(group)).where(F.size("part") > 0)
    segments = materialise(segments, where, "segments")
    prefix = vertices.select("sig", "n", "alone", F.posexplode(F.slice("grams", F.lit(1), (F.col("prefix") - F.col("alone")).cast("int"))).alias("k", "gram")).select("gram", "sig", "n", "alone", (F.col("alone") + F.col("k")).alias("pos"))
    prefix = materialise(prefix, where, "prefix")

    links = spark.createDataFrame([], "a long, b long")
    names = links.select(F.col("a").alias("id"), F.col("b").alias("root"))
    for turn in range(3):
        rows = prefix.join(names.withColumnRenamed("id", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
        open_ = rows.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
        rows = rows.join(open_.select("gram"), "gram", "left_semi")
        if turn < 2:
            # partners: the one before it, and of its length the one with the least that nobody shares, which lies nearest to the middle of a group
            rows = rows.withColumn("length", F.floor(F.log("n") / F.log(F.lit(100.0 / percent))))
            hubs = rows.groupBy("gram", "length").agg(F.min(F.struct("alone", "n", "sig", "root")).alias("hub"))
            near = Window.partitionBy("gram", F.pmod("sig", F.lit(8))).orderBy("root", "n", "sig")
            rows = rows.withColumn("before", F.lag(F.struct("alone", "n", "sig", "root")).over(near)).join(hubs, ["gram", "length"])
            cand = rows.select(F.col("sig").alias("a"), "n", "root", F.explode(F.array("before", "hub")).alias("p")).where("p is not null and p.root <> root")
            cand = cand.where((F.col("p.n") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("p.n") * percent))
            best = cand.groupBy("a", F.col("p.sig").alias("b")).agg(F.count("*").alias("c"), F.min("p.alone").alias("u"))
            best = best.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("c"), "u", "b"))).where("r <= 3")
            pairs = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        else:
            pairs = _all_pairs(rows, percent)
        pairs = materialise(pairs, where, f"pairs-{turn}")
        found = _verified(pairs, segments, where, f"found-{turn}", percent)
        links = links.unionAll(found)
        names = materialise(components(links, f"{where}/turn-{turn}"), where, f"names-{turn}")
    drop(spark, where, "prefix", "segments", "vertices", *(f"pairs-{t}" for t in range(3)))

    member = F.arrays_zip("ids", "marks")
    first = F.array_min(F.transform(member, lambda m: F.struct(m["ids"].isNull().alias("none"), m["ids"].alias("id"), m["marks"].alias("mark"))))
    some = listed.where("n > 0")
    of_set = materialise(some.select("sig", first.alias("first")).groupBy("sig").agg(F.min("first").alias("first")), where, "firsts")
    linked = of_set.join(names.withColumnRenamed("id", "sig"), "sig")
    salt = F.pmod("sig", F.lit(SALTS))  # a component may hold a third of all rows
    least = linked.groupBy("root").agg(F.min("first").alias("top")).select("root", "top", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    tops = linked.withColumn("salt", salt.cast("int")).join(least, ["root", "salt"]).select("sig", "top")
    tops = of_set.join(tops, "sig", "left").select("sig", F.coalesce("top", "first").alias("top"))
    rows = some.select("sig", "n", member.alias("m")).join(tops, "sig").select("n", "top", F.explode("m").alias("m"))
    rows = rows.select(F.col("m.ids").alias("doc_id"), F.col("m.marks").alias("mark"), F.col("n").alias("n_shingles"), F.col("top.id").alias("component_id"), (F.col("m.ids").eqNullSafe(F.col("top.id")) & (F.col("m.marks") == F.col("top.mark"))).alias("kept"))
    bare = listed.where("n = 0").select("n", F.explode(member).alias("m"))
    return rows.unionAll(bare.select(F.col("m.ids").alias("doc_id"), F.col("m.marks").alias("mark"), F.col("n").alias("n_shingles"), F.col("m.ids").alias("component_id"), F.lit(True).alias("kept")))
