"""Reachability by frontier rounds, shortest paths and all paths.

A round joins the newest frontier with the links and drops what was seen. Each frontier
is written to the shared workspace, so plans stay flat and a lost executor costs one
round; frontiers are small against the links and meet them in one shuffle join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.store import materialise, workspace


def reach(adj: DataFrame, seeds: DataFrame, depth: int | None = None, keep_seeds: bool = True) -> DataFrame:
    """(id, dist) of all that seeds(id) reach over adj(a, b). Without keep_seeds a seed counts only if a path leads back to it."""
    spark = adj.sparkSession
    where = workspace(spark, "reach")
    links = adj.select("a", "b").distinct().persist()
    start = materialise(seeds.select("id").distinct().withColumn("dist", F.lit(0)), f"{where}/0")
    paths, frontier, k = ([f"{where}/0"] if keep_seeds else []), start, 0
    while depth is None or k < depth:
        k += 1
        step = links.join(frontier.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct()
        if paths:
            step = step.join(spark.read.schema(start.schema).parquet(*paths).select("id"), "id", "left_anti")
        frontier = materialise(step.withColumn("dist", F.lit(k)), f"{where}/{k}")
        if frontier.isEmpty():
            break
        paths.append(f"{where}/{k}")
    links.unpersist()
    return spark.read.schema(start.schema).parquet(*paths) if paths else start.limit(0)


def reverse(adj: DataFrame) -> DataFrame:
    return adj.select(F.col("b").alias("a"), F.col("a").alias("b"))


def impact_of(adj: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """All transitive callers of the seeds; a seed itself only if it lies on a cycle."""
    return reach(reverse(adj), seeds, depth, keep_seeds=False)


def shortest_path(adj: DataFrame, start: str, goal: str) -> DataFrame:
    """(hop, id) along the shortest path, of several the one whose ids come first; empty if there is none."""
    spark = adj.sparkSession
    one = spark.createDataFrame([(start,)], "id string")
    back = reach(reverse(adj), spark.createDataFrame([(goal,)], "id string"))
    hit = back.where(F.col("id") == start).select("dist").collect()
    if not hit:
        return one.select(F.lit(0).alias("hop"), "id").limit(0)
    # every step goes to the least id that is one hop nearer: the driver holds the path alone
    path, here = [start], start
    near = back.persist()
    for d in range(hit[0]["dist"] - 1, -1, -1):
        here = adj.where(F.col("a") == here).join(near.where(F.col("dist") == d), adj["b"] == near["id"], "left_semi").agg(F.min("b")).first()[0]
        path.append(here)
    near.unpersist()
    return spark.createDataFrame(list(enumerate(path)), "hop int, id string")


def all_paths(adj: DataFrame, start: str, goal: str, depth: int = 6) -> DataFrame:
    """(path, hops): simple paths of at most depth links, as one statement. The set of paths can grow exponentially; depth is its bound."""
    spark = adj.sparkSession
    return spark.sql(
        """
        WITH RECURSIVE walk(id, path, hops) AS (
          SELECT CAST(:start AS STRING), array(CAST(:start AS STRING)), 0
          UNION ALL
          SELECT l.b, array_append(walk.path, l.b), walk.hops + 1 FROM walk JOIN {links} AS l ON l.a = walk.id
          WHERE walk.hops < :depth AND walk.id <> :goal AND NOT array_contains(walk.path, l.b)
        ) SELECT array_join(path, ' > ') AS path, hops FROM walk WHERE id = :goal AND hops > 0
        """,
        args={"start": start, "goal": goal, "depth": depth},
        links=adj,
    )


def topo_rank(adj: DataFrame) -> DataFrame:
    """(id, rank): length of the longest path that ends at a node; nodes on or behind a cycle have none."""
    spark = adj.sparkSession
    where = workspace(spark, "topo")
    links = adj.where("a <> b").select("a", "b").distinct()
    rest, k, done = materialise(links, f"{where}/links-0"), 0, []
    ids = materialise(links.select(F.col("a").alias("id")).union(links.select("b")).distinct(), f"{where}/ids-0")
    while True:
        first = ids.join(rest.select(F.col("b").alias("id")), "id", "left_anti")
        first = materialise(first.withColumn("rank", F.lit(k)), f"{where}/rank-{k}")
        if first.isEmpty():
            break
        done.append(f"{where}/rank-{k}")
        k += 1
        ids = materialise(ids.join(first, "id", "left_anti"), f"{where}/ids-{k}")
        rest = materialise(rest.join(first.select(F.col("id").alias("a")), "a", "left_anti"), f"{where}/links-{k}")
    return spark.read.schema("id string, rank int").parquet(*done) if done else first
