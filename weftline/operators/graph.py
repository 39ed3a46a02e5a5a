"""Coupling, smells and dead nodes over nodes(id, kind, layer, ...) and edges(source, target, type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Link types that are walked from the declaration to what implements it.
REVERSED = ("implements", "extends", "overrides")
#: Link types that are no application dependency.
NOT_APP = ("renders", "passes", "implements", "extends", "overrides")
#: Order of the layers; others have none.
RANKS = {"controller": 0, "service": 1, "repository": 2, "client": 2, "model": 3}
#: Thresholds of the coupling finders.
HUB, HELPER, HELPER_I, COORDINATOR, COORDINATOR_IN = 5, 10, 0.1, 10, 2
WRONG_IN, WRONG_LOW, WRONG_HIGH, GOD_METHODS, GOD_LINKS = 5, 0.3, 0.7, 12, 8


def known_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two ends exist."""
    ids = nodes.select("id")
    return edges.join(ids, edges["source"] == ids["id"], "left_semi").join(ids, edges["target"] == ids["id"], "left_semi")


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that does not exist."""
    ids = nodes.select("id").distinct()
    a = edges.join(ids, edges["source"] == ids["id"], "left_anti")
    b = edges.join(ids, edges["source"] == ids["id"], "left_semi").join(ids, edges["target"] == ids["id"], "left_anti")
    return a.unionByName(b)


def adjacency(edges: DataFrame) -> DataFrame:
    """(a, b): the direction in which an edge is walked."""
    back = F.col("type").isin(*REVERSED)
    return edges.select(F.when(back, F.col("target")).otherwise(F.col("source")).alias("a"), F.when(back, F.col("source")).otherwise(F.col("target")).alias("b")).distinct()


def app_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct dependencies between nodes outside tests, without a node's own."""
    live = nodes.where(F.coalesce(F.col("layer"), F.lit("unknown")) != "test").select("id")
    kept = edges.where(~F.col("type").isin(*NOT_APP) & (F.col("source") != F.col("target")))
    return kept.join(live, kept["source"] == live["id"], "left_semi").join(live, kept["target"] == live["id"], "left_semi").select("source", "target", "type").distinct()


def instability(fan_in: Column, fan_out: Column) -> Column:
    return F.when(fan_in + fan_out == 0, F.lit(0.0)).otherwise(F.round(fan_out / (fan_in + fan_out), 6))


def coupling(nodes: DataFrame, app: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out, degree, instability) of every node: one shuffle of both ends together."""
    ends = app.select("source", "target").distinct().select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    every = ends.select("e.*").unionByName(nodes.select("id", F.lit(0).alias("i"), F.lit(0).alias("o")))
    sums = every.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return sums.select("id", "fan_in", "fan_out", (F.col("fan_in") + F.col("fan_out")).alias("degree"), instability(F.col("fan_in"), F.col("fan_out")).alias("instability"))


def hubs(c: DataFrame) -> DataFrame:
    return c.where((F.col("fan_in") >= HUB) & (F.col("fan_out") >= HUB))


def shared_helpers(c: DataFrame) -> DataFrame:
    return c.where((F.col("fan_in") >= HELPER) & (F.col("instability") <= HELPER_I))


def coordinators(c: DataFrame) -> DataFrame:
    return c.where((F.col("fan_out") >= COORDINATOR) & (F.col("fan_in") <= COORDINATOR_IN))


def wrong_way(c: DataFrame, app: DataFrame) -> DataFrame:
    """Much-used stable callers of unstable callees."""
    s = c.where((F.col("fan_in") >= WRONG_IN) & (F.col("instability") < WRONG_LOW)).select(F.col("id").alias("source"))
    t = c.where(F.col("instability") > WRONG_HIGH).select(F.col("id").alias("target"))
    return app.select("source", "target").distinct().join(s, "source", "left_semi").join(t, "target", "left_semi").select("source", "target")


def rank(layer: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, r in RANKS.items():
        out = F.when(layer == name, F.lit(r)).otherwise(out)
    return out


def layer_violations(nodes: DataFrame, app: DataFrame) -> DataFrame:
    """Dependencies from a lower layer to a higher one; calls over HTTP are exempt."""
    n = nodes.select("id", "layer", rank(F.col("layer")).alias("r")).where("r is not null")
    s = n.select(F.col("id").alias("source"), F.col("layer").alias("source_layer"), F.col("r").alias("rs"))
    t = n.select(F.col("id").alias("target"), F.col("layer").alias("target_layer"), F.col("r").alias("rt"))
    e = app.where("type <> 'http'").select("source", "target").distinct()
    return e.join(s, "source").join(t, "target").where("rt < rs").select("source", "target", "source_layer", "target_layer")


def god_objects(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, reason, count): classes of many methods, and nodes with many outgoing references."""
    many = nodes.where((F.coalesce("layer", F.lit("unknown")) != "test") & F.col("cls").isNotNull()).groupBy(F.col("cls").alias("name")).agg(F.count("*").alias("count")).where(F.col("count") >= GOD_METHODS).select("name", F.lit("methods").alias("reason"), "count")
    wide = edges.where("type = 'references'").groupBy(F.col("source").alias("name")).agg(F.countDistinct("target").alias("count")).where(F.col("count") >= GOD_LINKS).select("name", F.lit("references").alias("reason"), "count")
    return many.unionByName(wide)


def dead_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that nothing calls and nothing exempts.

    Called: the target of a link that is no inheritance, either end of implements or
    extends, the source of overrides, or named by a node's ambiguous list. Exempt:
    endpoints, components, controllers, tests, routes, entries, declarations, dunder
    names, and bodies that every subclass replaces. Columns that nodes lack exempt nothing.
    """
    has = set(nodes.columns)
    used = edges.where(~F.col("type").isin(*REVERSED) | F.col("type").isin("implements", "extends")).select(F.col("target").alias("id"))
    used = used.union(edges.where(F.col("type").isin(*REVERSED)).select("source"))
    if "ambiguous" in has:
        used = used.union(nodes.select(F.explode("ambiguous")))
    exempt = F.col("kind").isin("endpoint", "component") | F.coalesce(F.col("layer"), F.lit("")).isin("controller", "test") | bare_name(F.col("id")).rlike("^__.*__$")
    if "entry" in has:
        exempt |= F.col("entry").isNotNull()
    if "routes" in has:
        exempt |= F.coalesce(F.size("routes"), F.lit(0)) > 0
    for flag in ("declaration", "overridden"):
        if flag in has:
            exempt |= F.coalesce(F.col(flag), F.lit(False))
    return nodes.where(~F.coalesce(exempt, F.lit(False))).join(used.distinct(), "id", "left_anti")


def dead_files(nodes: DataFrame, dead: DataFrame) -> DataFrame:
    """(file, nodes): files of which every node is dead."""
    flag = nodes.select("id", "file").join(dead.select("id", F.lit(True).alias("gone")), "id", "left")
    return flag.groupBy("file").agg(F.count("*").alias("nodes"), F.bool_and(F.coalesce("gone", F.lit(False))).alias("all_dead")).where("all_dead and file is not null").select("file", "nodes")


def overridden(edges: DataFrame, extends: DataFrame) -> DataFrame:
    """(id, subclasses): bodies that as many subclasses override as extend their class. extends(sub, base), overrides as edges(source, target)."""
    subs = extends.groupBy(F.col("base").alias("id")).agg(F.countDistinct("sub").alias("subclasses"))
    over = edges.groupBy(F.col("target").alias("id")).agg(F.countDistinct("source").alias("overrides"))
    return subs.join(over, "id").where("subclasses = overrides").select("id", "subclasses")


#: Names that suggest a pattern.
PATTERNS = {"singleton": r"(?i)(singleton|getinstance|get_instance)", "factory": r"(?i)(factory|create[A-Z_]|make_)", "observer": r"(?i)(observer|listener|subscribe|on_event|emitter)", "react hook": r"^use[A-Z]"}


def detect_patterns(nodes: DataFrame) -> DataFrame:
    """(id, pattern)."""
    found = [nodes.where(F.col("name").rlike(p) & ((F.col("lang") == "js") if k == "react hook" else F.lit(True))).select("id", F.lit(k).alias("pattern")) for k, p in PATTERNS.items()]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def bare_name(c: Column) -> Column:
    """The last segment of an id, without the types of an overload."""
    return F.regexp_extract(F.regexp_replace(c, r"\(.*\)$", ""), r"([^.:/]+)$", 1)


def precision_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, precision): what a node's calls leave open: a call or request to a declaration may run any body of it, a
    request is matched by its name, and nodes(ambiguous) lists overload sets that no call could choose from."""
    bodies = nodes.where("declaration").select(F.col("id").alias("target"))
    out = edges.where("type in ('calls', 'http')").select(F.col("source").alias("id"), "target", "type")
    why = out.join(bodies, "target", "left_semi").select("id", F.lit("interface-dispatch").alias("p"))
    why = why.unionAll(out.where("type = 'http'").select("id", F.lit("name-matched")))
    why = why.unionAll(nodes.where(F.size(F.coalesce("ambiguous", F.array().cast("array<string>"))) > 0).select("id", F.lit("overloads")))
    return why.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("p")), ",").alias("precision"))


def merge_call_sites(sites: DataFrame) -> DataFrame:
    """One row a (source, target): first line, in any loop, under a condition everywhere, arms common to all sites."""
    common = F.array_sort(F.aggregate("all_arms", F.element_at("all_arms", 1), F.array_intersect))
    grouped = sites.groupBy("source", "target").agg(F.min("line").alias("line"), F.bool_or("loop").alias("loop"), F.bool_and("cond").alias("cond"), F.collect_set(F.filter(F.split("arms", ","), lambda x: x != "")).alias("all_arms"))
    return grouped.select("source", "target", "line", "loop", "cond", F.array_join(common, ",").alias("arms"))


def health(counts: dict[str, DataFrame]) -> DataFrame:
    """One row: capped deductions, score and grade. counts: one-row frames with the column named as its key:
    cycles, layer_violations, hubs, wrong_way, god_objects, dead_pct, high, med, low."""
    row = None
    for k, df in counts.items():
        one = df.select(F.col(k).cast("double").alias(k))
        row = one if row is None else row.crossJoin(one)  # one row each
    cap = lambda c, top: F.least(F.lit(float(top)), c)
    lost = {
        "d_cycles": cap(8 * F.col("cycles"), 24), "d_layers": cap(4 * F.col("layer_violations"), 16), "d_coupling": cap(3 * F.col("hubs"), 12), "d_wrong_way": cap(2 * F.col("wrong_way"), 8),
        "d_god": cap(3 * F.col("god_objects"), 12), "d_dead": cap(F.bround(0.5 * F.col("dead_pct")), 20), "d_security": cap(10 * F.col("high") + 4 * F.col("med") + F.col("low"), 30),
    }
    row = row.select(*[c.alias(k) for k, c in lost.items()])
    total = sum((F.col(k) for k in lost), F.lit(0.0))
    row = row.withColumn("score", F.greatest(F.lit(0.0), 100 - total))
    grade = F.when(F.col("score") >= 90, "A").when(F.col("score") >= 80, "B").when(F.col("score") >= 70, "C").when(F.col("score") >= 60, "D").otherwise("F")
    return row.withColumn("grade", grade)
