"""Strongly connected components: trimming, then forward and backward labels; a bounded rest is solved in one task."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.store import materialise, workspace

LAST = 200_000


def tarjan(links: list[tuple[str, str]]) -> dict[str, str]:
    """Least id of the component of every vertex; iterative."""
    out: dict[str, list[str]] = {}
    for a, b in links:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    on, stack, root = set(), [], {}
    for v in out:
        if v in index:
            continue
        work = [(v, iter(out[v]))]
        index[v] = low[v] = len(index)
        stack.append(v)
        on.add(v)
        while work:
            u, it = work[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out[w])))
                    break
                if w in on:
                    low[u] = min(low[u], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[u])
                if low[u] == index[u]:
                    own = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        own.append(w)
                        if w == u:
                            break
                    least = min(own)
                    root |= dict.fromkeys(own, least)
    return root


def _in_task(batches):
    links = [pair for b in batches for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    found = tarjan(links)
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.string())], ["id", "scc"])


def strong_components(edges: DataFrame, last: int = LAST) -> DataFrame:
    """(id, scc) of the vertices that lie on a cycle of two or more; scc is the least id of the component.

    Vertices without a way in or out are trimmed; each then takes the least id that
    reaches it (its colour), and a colour's root gathers those of its colour that reach
    it back: they are one component. The rest goes on. With at most ``last`` links left,
    one task solves them.
    """
    spark = edges.sparkSession
    where = workspace(spark, "scc")
    links = materialise(edges.where("source <> target").select(F.col("source").alias("a"), F.col("target").alias("b")).distinct(), f"{where}/links")
    found: list[DataFrame] = []
    k = 0
    while links.limit(last + 1).count() > last:
        k += 1
        j = 0
        while True:  # trim
            j += 1
            kept = links.join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
            kept = materialise(kept.join(kept.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"), f"{where}/trim-{k}-{j}")
            same = kept.count() == links.count()
            links = kept
            if same:
                break
        if links.isEmpty():
            break
        colour = materialise(links.select(F.col("a").alias("id")).union(links.select("b")).distinct().withColumn("c", F.col("id")), f"{where}/colour-{k}-0")
        n = 0
        while True:  # least id that reaches each vertex
            n += 1
            sent = links.join(colour.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.min("c").alias("m"))
            new = materialise(colour.join(sent, "id", "left").select("id", F.least("c", "m").alias("c"), (F.col("m") < F.col("c")).alias("moved")), f"{where}/colour-{k}-{n}")
            colour = new.select("id", "c")
            if new.where("moved").isEmpty():
                break
        ca, cb = colour.select(F.col("id").alias("a"), F.col("c").alias("ca")), colour.select(F.col("id").alias("b"), F.col("c").alias("cb"))
        inside = materialise(links.join(ca, "a").join(cb, "b").where("ca = cb").select("a", "b", F.col("ca").alias("c")), f"{where}/inside-{k}")
        back = materialise(colour.where("id = c"), f"{where}/back-{k}-0")
        paths, front, n = [f"{where}/back-{k}-0"], back, 0
        while True:  # what reaches the root within its colour
            n += 1
            step = inside.join(front.select(F.col("id").alias("b")), "b").select(F.col("a").alias("id"), "c").distinct()
            front = materialise(step.join(spark.read.parquet(*paths).select("id"), "id", "left_anti"), f"{where}/back-{k}-{n}")
            if front.isEmpty():
                break
            paths.append(f"{where}/back-{k}-{n}")
        done = spark.read.parquet(*paths).select("id", F.col("c").alias("scc"))
        found.append(done)
        gone = done.select("id")
        links = materialise(links.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti"), f"{where}/links-{k}")
    out = links.repartition(1).mapInArrow(_in_task, "id string, scc string")
    for f in found:
        out = out.unionByName(f)
    big = out.groupBy("scc").agg(F.count("*").alias("n")).where("n > 1").select("scc")
    return out.join(big, "scc", "left_semi").select("id", "scc")


def find_cycles(app: DataFrame, loops: DataFrame | None = None) -> DataFrame:
    """(size, members): components of two or more, and each self-link of loops(source, target) as a cycle of one."""
    many = strong_components(app).groupBy("scc").agg(F.count("*").alias("size"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("members")).select("size", "members")
    own = (app if loops is None else loops).where("source = target").select(F.lit(1).cast("long").alias("size"), F.col("source").alias("members")).distinct()
    return many.unionByName(own)
