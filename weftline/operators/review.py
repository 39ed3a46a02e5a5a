"""Joins of text findings, history and tests onto nodes and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def owner_of(findings: DataFrame, nodes: DataFrame) -> DataFrame:
    """findings(path, line_no, ...) with owner: of the nodes(id, path, start, end) around the line the smallest, else a node without a range that owns the file, else null.

    The equality on path deals the join; the range is its residual. The least id wins ties.
    """
    key = [F.col(c) for c in findings.columns]
    n = nodes.select(F.col("path").alias("_p"), "id", "start", "end")
    around = (F.col("path") == F.col("_p")) & (F.col("start").isNull() | F.col("line_no").between(F.col("start"), F.col("end")))
    near = F.struct(F.coalesce(F.col("end") - F.col("start"), F.lit(2147483647)), F.col("id"))
    return findings.join(n, around, "left").groupBy(*key).agg(F.min_by("id", near).alias("owner"))


def file_churn(commits: DataFrame) -> DataFrame:
    return commits.groupBy("path").agg(F.countDistinct("hash").alias("commits"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def file_authors(commits: DataFrame) -> DataFrame:
    """(path, author, commits)."""
    return commits.groupBy("path", "author").agg(F.countDistinct("hash").alias("commits"))


def file_owner(commits: DataFrame) -> DataFrame:
    """(path, owner): the author with most commits; of several the first by name."""
    return file_authors(commits).groupBy("path").agg(F.min_by("author", F.struct(-F.col("commits"), F.col("author"))).alias("owner"))


def churn_join(churn: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, path, commits): churn of the only path that is a node's file, or the trailing whole segments of it, or it of the path."""
    f, p = nodes.select("file").distinct(), churn.select("path").distinct()
    longer = suffixes(p, "path", "path").select("path", F.col("suffix").alias("file")).join(f, "file")
    shorter = suffixes(f, "file", "file").select("file", F.col("suffix").alias("path")).join(p, "path")
    hit = longer.select("file", "path").union(shorter.select("file", "path")).distinct()
    only = hit.groupBy("file").agg(F.count("*").alias("hits"), F.min("path").alias("path")).where("hits = 1").select("file", "path")
    return nodes.select("id", "file").join(only.join(churn.select("path", "commits"), "path"), "file").select("id", "path", "commits")


def hotspots(churn: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, commits, fan_in, fan_out, risk) over all edges; risk above 0."""
    i, o = edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("fan_in")), edges.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("fan_out"))
    r = churn_join(churn, nodes).join(i, "id", "left").join(o, "id", "left").fillna(0, ["fan_in", "fan_out"])
    return r.select("id", "commits", "fan_in", "fan_out", (F.col("commits") * (1 + F.col("fan_in") + F.col("fan_out"))).alias("risk")).where("risk > 0")


#: Paths of a key that go together, and nodes of a key that meet them in one task.
PATHS, NODES = 500, 20000


def seen_keys(nodes: DataFrame, tests: DataFrame) -> DataFrame:
    """(name, cls, path): the paths of tests(path, ident) that hold a name, and class if any, that nodes have. A row a key and path, whatever the number of its nodes."""
    i = tests.select("path", "ident").distinct()
    byname = nodes.select("name", "cls").distinct().join(i.withColumnRenamed("ident", "name"), "name")
    owned = byname.where("cls is not null").join(i.withColumnRenamed("ident", "cls"), ["path", "cls"], "left_semi")
    return byname.where("cls is null").select("name", "cls", "path").unionByName(owned.select("name", "cls", "path"))


def tests_join(nodes: DataFrame, tests: DataFrame) -> DataFrame:
    """(id, path), once each: nodes(id, name, cls) whose name, and class if any, a test's identifiers(path, ident) hold.

    The paths of a key go in lists, the nodes of a key in slices, and a list meets a slice in one
    place: what is sent grows with nodes and tests, only the result with their product.
    """
    one = nodes.select("id", F.struct("name", "cls").alias("key")).groupBy("id").agg(F.collect_set("key").alias("keys"))
    n = one.select("id", F.explode("keys").alias("key"), (F.size("keys") > 1).alias("several"))
    seen = seen_keys(nodes, tests).select(F.struct("name", "cls").alias("key"), "path")
    sizes = seen.groupBy("key").agg(F.ceil(F.count("*") / PATHS).cast("int").alias("lists")).join(n.groupBy("key").agg(F.ceil(F.count("*") / NODES).cast("int").alias("slices")), "key")
    part = lambda c, k: F.pmod(F.xxhash64(c), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    lists = seen.join(sizes, "key").groupBy("key", "slices", part("path", "lists").alias("list")).agg(F.collect_list("path").alias("paths"))
    lists = lists.select("key", "list", every("slices").alias("slice"), "paths")
    sent = n.join(sizes, "key").select("id", "several", "key", part("id", "slices").alias("slice"), every("lists").alias("list"))
    place, tasks = ["key", "slice", "list"], int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number: little input makes many rows
    met = sent.repartition(tasks, *place).join(lists.repartition(tasks, *place), place)
    once = met.where("not several").select("id", F.explode("paths").alias("path"))
    return once.unionByName(met.where("several").select("id", F.explode("paths").alias("path")).distinct())


def tested(nodes: DataFrame, tests: DataFrame) -> DataFrame:
    """(id, nodes, hit): how many nodes have an id, and whether a test holds any of them, as tests_join would tell; no pair is made."""
    k = seen_keys(nodes, tests).select(F.struct("name", "cls").alias("key")).distinct().withColumn("hit", F.lit(True))
    n = nodes.select("id", F.struct("name", "cls").alias("key")).join(k, "key", "left")
    return n.groupBy("id").agg(F.count("*").alias("nodes"), F.coalesce(F.bool_or("hit"), F.lit(False)).alias("hit"))


def manifest_diff(now: DataFrame, cached: DataFrame) -> DataFrame:
    """(path, change) of manifests(path, sha): added, deleted, modified. A null sha is a value like others."""
    n, c = now.select("path", F.struct("sha").alias("n")), cached.select("path", F.struct("sha").alias("c"))
    change = F.when(F.col("c").isNull(), "added").when(F.col("n").isNull(), "deleted").when(~F.col("n.sha").eqNullSafe(F.col("c.sha")), "modified")
    return n.join(c, "path", "full").select("path", change.alias("change")).where("change is not null")


def freshness(now: DataFrame, cached: DataFrame, grammars: DataFrame, cached_grammars: DataFrame, roots: DataFrame, cached_roots: DataFrame) -> DataFrame:
    """(stale, reasons): changed files, grammars(name, version) that differ, and roots(root) of which none is where it was."""
    changed = manifest_diff(now, cached).select(F.col("change").alias("reason"))
    drift = manifest_diff(grammars.toDF("path", "sha"), cached_grammars.toDF("path", "sha")).select(F.lit("grammar drift").alias("reason"))
    common = roots.join(cached_roots, "root", "left_semi").agg(F.count("*").alias("k"))
    moved = common.crossJoin(cached_roots.agg(F.count("*").alias("n"))).where("k = 0 and n > 0").select(F.lit("source root moved").alias("reason"))  # one row each
    every = changed.unionAll(drift).unionAll(moved)
    return every.agg((F.count("*") > 0).alias("stale"), F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"))


def shared_ids(names: DataFrame) -> DataFrame:
    """(id, path, name): names(path, name) that several files hold, whatever their case, get the file's stem, and its path where stems meet too."""
    low = Window.partitionBy(F.lower("name"))
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    r = names.distinct().withColumn("files", F.size(F.collect_set("path").over(low))).withColumn("stem", stem)
    r = r.withColumn("same", F.count("*").over(Window.partitionBy(F.lower("name"), F.lower("stem"))))
    new = F.when(F.col("files") == 1, F.col("name")).when(F.col("same") == 1, F.concat_ws(".", "stem", "name")).otherwise(F.concat_ws(".", F.regexp_replace("path", r"\.[^./]*$", ""), "name"))
    return r.select(new.alias("id"), "path", "name")


def suffixes(paths: DataFrame, key: str, column: str) -> DataFrame:
    """(key, suffix, segments): every trailing run of whole segments."""
    parts = F.split(column, "/")
    runs = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, -k, k), "/").alias("suffix"), k.alias("segments")))
    return paths.select(key, F.explode(runs).alias("r")).select(key, "r.suffix", "r.segments")


def route_exact(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """(caller, handler) of calls(caller, method, path) and routes(handler, method, path)."""
    return calls.join(routes, ["method", "path"]).select("caller", "handler").distinct()


def route_suffix(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """(caller, handler): the route is a trailing run of the call's path, and the only one."""
    s = suffixes(calls.withColumn("key", F.struct("caller", "method")), "key", "path").select("key.caller", "key.method", F.col("suffix").alias("path"))
    hit = s.join(routes, ["method", "path"]).select("caller", "handler").distinct()
    return hit.withColumn("n", F.count("*").over(Window.partitionBy("caller"))).where("n = 1").select("caller", "handler")


def route_prefix(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """(caller, handler): the call is a trailing run of the route's path, begins with a literal, and fits one route."""
    s = suffixes(routes.withColumn("key", F.struct("handler", "method")), "key", "path").select("key.handler", "key.method", F.col("suffix").alias("path"))
    hit = calls.where("path not like '{%'").join(s, ["method", "path"]).select("caller", "handler").distinct()
    return hit.withColumn("n", F.count("*").over(Window.partitionBy("caller"))).where("n = 1").select("caller", "handler")
