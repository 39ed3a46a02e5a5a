"""Embedding near-duplicates by exact products of blocks.

Vectors are scaled to length one in double precision; equal ones become one node. A
bounded sample of nodes fits centroids; every node lies in its nearest cell, and a cell
above ``cap`` nodes is dealt into blocks by hash. A block is a file in the workspace.

Every pair of blocks that can hold a pair at the threshold is met in one task: two
nodes of at least that cosine are at most acos(cosine) apart, so a node is left out
against a block only if it is farther than that from the block's ball (the largest angle
to the centroid) or from the plane between the two cells; all others are multiplied in
double precision. Nothing is left to chance: n_links is what brute force counts. Blocks
are met in square tiles, so that a block is read once per tile. Links are counted
in the task and reach the rest of the plan as counts and a spanning forest; no pairs
travel. ``audit`` measures recall against brute force.

Null, zero, non-finite vectors, vectors with a null component or of another length
than most link with nothing. Repeated ids keep a row each; a component is named by its
least vec_id (nulls last). An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._components import components
from weftline.llm._store import get, materialise, put, tidy, workspace

COSINE = 0.9
CELL, CAP, SAMPLE = 1500, 4000, 20_000
QUERIES, TILE = 512, 8


def units(batches):
    """(vec_id, u): u is the unit vector's bytes, null where there is none."""
    for batch in batches:
        out = []
        for v in batch.column(1):
            x = np.array(v.values, np.float64) if v.is_valid and v.values.null_count == 0 and len(v.values) else None
            top = np.abs(x).max() if x is not None else 0.0
            if x is None or not np.isfinite(top) or top == 0:
                out.append(None)
                continue
            x = x / top
            out.append((x / np.sqrt(x @ x) + 0.0).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "u"])


def matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


def centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    c = x[np.random.default_rng(5).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[a : a + 2000] @ c.T).argmax(1) for a in range(0, len(x), 2000)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def near_plane(u: np.ndarray, own: np.ndarray, other: np.ndarray, radius: float, cosine: float) -> np.ndarray:
    """Which rows of u, all nearer to the centroid own, can have a node of at least cosine in the cell of other, whose nodes are within radius of it."""
    here, there = u @ own, u @ other
    ball = np.arccos(np.clip(there, -1, 1)) <= radius + np.arccos(cosine) + 1e-6
    return ball & (here - there <= np.sqrt(2 - 2 * cosine) * np.linalg.norm(own - other) + 1e-6)


def join(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Renames label, by which a node points to the least node of its component, by the links (x, y)."""
    while True:
        la, lb = label[x], label[y]
        open_ = la != lb
        if not open_.any():
            return
        x, y, la, lb = x[open_], y[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _pack(where: str, c: np.ndarray):
    """Writes a block: nids, multiplicities, vectors."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("nid")
        cell, sub = table.column("cell")[0].as_py(), table.column("sub")[0].as_py()
        u = matrix(table.column("u"), c.shape[1])
        put(f"{where}/blocks/{cell}-{sub}", [table.column(k).to_numpy().astype("<i8").tobytes() for k in ("nid", "mult")] + [u.tobytes()])
        radius = float(np.arccos(np.clip(u @ c[cell], -1, 1)).max())
        return pa.table({"cell": pa.array([cell]), "sub": pa.array([sub]), "radius": pa.array([radius])})

    return run


def _meet(where: str, c: np.ndarray, blocks: list, tile: int, cosine: float):
    """Tasks over numbers of tile pairs: (a, b, n) are n links of node a, or where n is -1 a link of a spanning forest."""
    width = c.shape[1]

    def load(t: int) -> list:
        out = []
        for cell, sub, radius in blocks[t * tile : (t + 1) * tile]:
            data = get(f"{where}/blocks/{cell}-{sub}")
            n = len(data) // (8 * (width + 2))
            ints = np.frombuffer(data, "<i8", 2 * n)
            out.append((cell, radius, ints[:n], ints[n:], np.frombuffer(data, np.float64, offset=16 * n).reshape(n, width)))
        return out

    def pair(left: list, right: list | None) -> pa.RecordBatch:
        """right: None for the left tile with itself."""
        all_ = left + (right or [])
        at = np.cumsum([0] + [len(x[2]) for x in all_])
        nid = np.concatenate([x[2] for x in all_])
        total, label = np.zeros(len(nid), np.int64), np.arange(len(nid))
        for i, (ci, ri, _, mi, ui) in enumerate(left):
            for j in range(i if right is None else len(left), len(all_)):
                cj, rj, _, mj, uj = all_[j]
                r, k = np.arange(len(ui)), np.arange(len(uj))
                if ci != cj:
                    r = np.flatnonzero(near_plane(ui, c[ci], c[cj], rj, cosine))
                    k = np.flatnonzero(near_plane(uj, c[cj], c[ci], ri, cosine)) if len(r) else r
                v, m = (uj, mj) if len(k) == len(uj) else (uj[k], mj[k])
                for lo in range(0, len(r) if len(k) else 0, QUERIES):
                    rows = r[lo : lo + QUERIES]
                    link = ui[rows] @ v.T >= cosine
                    if i == j:
                        link[np.arange(len(rows)), rows] = False
                    x, y = np.nonzero(link)
                    if not len(x):
                        continue
                    total[at[i] : at[i + 1]][rows] += np.bincount(x, m[y], len(rows)).astype(np.int64)
                    if i != j:
                        total[at[j] : at[j + 1]][k] += np.bincount(y, mi[rows][x], len(k)).astype(np.int64)
                    join(label, at[i] + rows[x], at[j] + k[y])
        some, tied = np.flatnonzero(total), np.flatnonzero(label != np.arange(len(label)))
        a, b = np.concatenate([nid[some], nid[tied]]), np.concatenate([np.full(len(some), -1), nid[label[tied]]])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.concatenate([total[some], np.full(len(tied), -1)]))], ["a", "b", "n"])

    tiles = -(-len(blocks) // tile)

    def run(batches):
        kept: tuple[int, list] = (-1, [])
        for batch in batches:
            for p in batch.column(0).to_pylist():
                i, d = divmod(p, tiles // 2 + 1)  # tile i with tile i + d, around the end: each pair of tiles once
                if 2 * d == tiles and i >= d:
                    continue
                if kept[0] != i:
                    kept = (i, load(i))
                yield pair(kept[1], load((i + d) % tiles) if d else None)

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, cell_size: int = CELL, cap: int = CAP, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors."""
    spark = vectors.sparkSession
    where = workspace(spark, "neighbours")
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(tidy(units), "vec_id long, u binary")
    raw = materialise(raw.withColumn("nid", F.xxhash64("u")), where, "units")
    width = raw.where("u is not null").groupBy(F.octet_length("u").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).limit(1).collect()
    width = width[0]["w"] // 8 if width else 0
    rows = raw.select("vec_id", F.when(F.octet_length("u") == width * 8, F.col("nid")).alias("nid"))
    nodes = materialise(raw.where(F.octet_length("u") == width * 8).groupBy("nid", "u").agg(F.count("*").alias("mult")), where, "nodes")
    count = nodes.count()
    if count == 0:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sample = nodes.select("nid", "u").orderBy("nid").limit(SAMPLE).toArrow()  # nid is a hash: a random, bounded sample
    c = centroids(matrix(sample.column("u"), width), max(1, min(len(sample), -(-count // cell_size))))

    def assign(batches):
        for batch in batches:
            home = (matrix(batch.column("u"), width) @ c.T).argmax(1)
            yield pa.RecordBatch.from_arrays([pa.array(home), *batch.columns], ["cell", *batch.schema.names])

    placed = materialise(nodes.mapInArrow(tidy(assign), "cell long, nid long, u binary, mult long"), where, "placed")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / cap).alias("subs"))
    placed = placed.join(sizes.hint("shuffle_hash"), "cell").withColumn("sub", F.pmod(F.shiftright("nid", 9), "subs")).select("cell", "sub", "nid", "u", "mult")
    packed = materialise(placed.groupBy("cell", "sub").applyInArrow(_pack(where, c), "cell long, sub long, radius double"), where, "packed")
    blocks = sorted(tuple(x) for x in packed.collect())
    tile = max(1, min(TILE, len(blocks) // 64))
    tiles = -(-len(blocks) // tile)
    pairs = tiles * (tiles // 2 + 1)
    tasks = spark.range(0, pairs, 1, min(pairs, max(4 * spark.sparkContext.defaultParallelism, pairs // 16)))
    found = tasks.mapInArrow(tidy(_meet(where, c, blocks, tile, cosine)), "a long, b long, n long")
    found = materialise(found, where, "found")
    links = found.where("n >= 0").groupBy(F.col("a").alias("nid")).agg(F.sum("n").alias("k"))
    names = components(found.where("n < 0").select("a", "b"), where)
    info = materialise(nodes.select("nid", "mult").join(links, "nid", "left").join(names.withColumnRenamed("id", "nid"), "nid", "left").select("nid", (F.col("mult") - 1 + F.coalesce("k", F.lit(0))).alias("n_links"), F.coalesce("root", "nid").alias("root")), where, "info")
    base = rows.join(info, "nid", "left")
    least = base.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("least"))
    out = base.join(least, "root", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def audit(vectors: DataFrame, result: DataFrame, cosine: float = COSINE, every: int = 20) -> float:
    """Recall: links that near_duplicates counted for the rows with vec_id divisible by every, over those that brute force finds."""
    v = vectors.select("vec_id", "embedding").where(F.col("vec_id") % every == 0).toPandas()
    q = np.stack(v["embedding"]).astype(float)
    q /= np.linalg.norm(q, axis=1, keepdims=True)

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([pa.array(v["vec_id"].to_numpy()), pa.array((q @ x.T >= cosine).sum(1))], ["vec_id", "k"])

    true = vectors.select("vec_id", "embedding").mapInArrow(tidy(run), "vec_id long, k long").groupBy("vec_id").agg((F.sum("k") - 1).alias("k"))
    both = true.join(result, "vec_id").agg(F.sum(F.least("k", "n_links")).alias("got"), F.sum("k").alias("all")).first()
    return 1.0 if not both["all"] else both["got"] / both["all"]
