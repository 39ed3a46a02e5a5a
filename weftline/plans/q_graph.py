"""Graph queries over the relational adapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import cycles, graph, paths
from weftline.plans.q_text import DEBT, FINDINGS
from weftline.plans.registry import register
from weftline.sources import adapters as A

STAR, STAR_N, LOOSE_N = A.text(A.STAR_EDGES), A.text(A.STAR_NODES), A.text(A.LOOSE_NODES)
TRADE, TRADE_N = A.text(A.TRADE_EDGES), A.text(A.TRADE_NODES)
SESSION, SESSION_N, SITES = A.text(A.SESSION_EDGES), A.text(A.SESSION_NODES), A.text(A.SESSION_SITES)
SOURCE, SOURCE_N, TREE = A.text(A.SOURCE_EDGES), A.text(A.SOURCE_NODES), A.text(A.TREE_EDGES)


def pair(spark, sf, nodes, edges):
    return A.stored(spark, sf, nodes), A.stored(spark, sf, edges)


def app(nodes: str, edges: str) -> str:
    """CTEs n, e and app."""
    return f"""n AS ({nodes}), e AS ({edges}), app AS (
  SELECT DISTINCT source, target, type FROM e WHERE type NOT IN ('renders', 'passes', 'implements', 'extends', 'overrides') AND source <> target
    AND source IN (SELECT id FROM n WHERE layer <> 'test') AND target IN (SELECT id FROM n WHERE layer <> 'test'))"""


COUPLING = """ends AS (SELECT source AS id, 0 AS i, 1 AS o FROM (SELECT DISTINCT source, target FROM app) UNION ALL SELECT target, 1, 0 FROM (SELECT DISTINCT source, target FROM app) UNION ALL SELECT id, 0, 0 FROM n),
c AS (SELECT id, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out, CAST(sum(i + o) AS BIGINT) AS degree,
  CASE WHEN sum(i + o) = 0 THEN 0.0 ELSE round(sum(o) / sum(i + o), 6) END AS instability FROM ends GROUP BY id)"""


def star(spark, sf):
    n, e = pair(spark, sf, A.STAR_NODES, A.STAR_EDGES)
    return n, graph.app_edges(n, e)


def star_coupling(spark, sf):
    return graph.coupling(*star(spark, sf))


WITH_STAR = f"WITH {app(STAR_N, STAR)}, {COUPLING} "


@register("edge_node_join", f"WITH n AS ({STAR_N}), e AS ({STAR}) SELECT e.* FROM e WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n)")
def edge_node_join(spark, sf):
    return graph.known_edges(*pair(spark, sf, A.STAR_NODES, A.STAR_EDGES))


@register("read_graph", f"WITH n AS ({SESSION_N}), e AS ({SESSION}) SELECT e.source, e.target, e.type FROM e WHERE source IN (SELECT id FROM n WHERE layer <> 'model') AND target IN (SELECT id FROM n WHERE layer <> 'model')")
def read_graph(spark, sf):
    from weftline.sources.readers import read_graph_json

    n, e = pair(spark, sf, A.SESSION_NODES, A.SESSION_EDGES)
    return read_graph_json(n.where("layer <> 'model'").select(F.to_json(F.struct("*")).alias("json")), e.select(F.to_json(F.struct("*")).alias("json"))).select("source", "target", "type")


@register("dangling_edges", f"WITH n AS (SELECT * FROM ({STAR_N}) WHERE layer <> 'client'), e AS ({STAR}) SELECT * FROM e WHERE source NOT IN (SELECT id FROM n) OR target NOT IN (SELECT id FROM n)")
def dangling_edges(spark, sf):
    n, e = pair(spark, sf, A.STAR_NODES, A.STAR_EDGES)
    return graph.dangling_edges(n.where("layer <> 'client'"), e)


@register("adjacency", f"SELECT DISTINCT CASE WHEN type IN ('implements', 'extends', 'overrides') THEN target ELSE source END AS a, CASE WHEN type IN ('implements', 'extends', 'overrides') THEN source ELSE target END AS b FROM ({TREE})")
def adjacency(spark, sf):
    return graph.adjacency(A.stored(spark, sf, A.TREE_EDGES))


@register("app_edges", f"WITH {app(LOOSE_N, STAR)} SELECT source, target, type FROM app")
def app_edges(spark, sf):
    return graph.app_edges(*pair(spark, sf, A.LOOSE_NODES, A.STAR_EDGES))


@register("coupling", WITH_STAR + "SELECT * FROM c")
def coupling(spark, sf):
    return star_coupling(spark, sf)


@register("instability", WITH_STAR + "SELECT id, instability FROM c")
def instability(spark, sf):
    return star_coupling(spark, sf).select("id", "instability")


@register("find_hubs", WITH_STAR + "SELECT * FROM c WHERE fan_in >= 5 AND fan_out >= 5")
def find_hubs(spark, sf):
    return graph.hubs(star_coupling(spark, sf))


@register("find_shared_helpers", WITH_STAR + "SELECT * FROM c WHERE fan_in >= 10 AND instability <= 0.1")
def find_shared_helpers(spark, sf):
    return graph.shared_helpers(star_coupling(spark, sf))


@register("find_coordinators", WITH_STAR + "SELECT * FROM c WHERE fan_out >= 10 AND fan_in <= 2")
def find_coordinators(spark, sf):
    return graph.coordinators(star_coupling(spark, sf))


#: One stable node in front of an unstable one: no adapter graph holds such a pair.
WRONG_PROBE = "SELECT 'probe:stable' AS source, 'order:' || CAST(o_orderkey AS STRING) AS target, 'calls' AS type FROM {orders} WHERE o_orderkey = 1 UNION ALL SELECT 'customer:' || CAST(c_custkey AS STRING), 'probe:stable', 'calls' FROM {customer}"
WRONG_NODES = f"SELECT id, layer FROM ({A.STAR_NODES}) AS a UNION ALL SELECT 'probe:stable', 'service'"
WRONG_EDGES = f"SELECT * FROM ({A.STAR_EDGES}) AS a UNION ALL SELECT * FROM ({WRONG_PROBE}) AS b"


@register("find_wrong_way_deps", f"WITH {app(A.text(WRONG_NODES), A.text(WRONG_EDGES))}, {COUPLING} SELECT DISTINCT source, target FROM app JOIN c AS s ON s.id = source JOIN c AS t ON t.id = target WHERE s.fan_in >= 5 AND s.instability < 0.3 AND t.instability > 0.7")
def find_wrong_way_deps(spark, sf):
    n, e = pair(spark, sf, WRONG_NODES, WRONG_EDGES)
    a = graph.app_edges(n, e)
    return graph.wrong_way(graph.coupling(n, a), a)


RANK = "CASE {} WHEN 'controller' THEN 0 WHEN 'service' THEN 1 WHEN 'repository' THEN 2 WHEN 'client' THEN 2 WHEN 'model' THEN 3 END"


@register("find_layer_violations", f"WITH {app(SESSION_N, SESSION)} SELECT DISTINCT source, target, s.layer AS source_layer, t.layer AS target_layer FROM app JOIN n AS s ON s.id = source JOIN n AS t ON t.id = target WHERE type <> 'http' AND {RANK.format('t.layer')} < {RANK.format('s.layer')}")
def find_layer_violations(spark, sf):
    n, e = pair(spark, sf, A.SESSION_NODES, A.SESSION_EDGES)
    return graph.layer_violations(n, graph.app_edges(n, e))


@register("find_god_objects", f"SELECT cls AS name, 'methods' AS reason, count(*) AS count FROM ({LOOSE_N}) WHERE cls IS NOT NULL AND layer <> 'test' GROUP BY cls HAVING count(*) >= 12 UNION ALL SELECT source, 'references', count(DISTINCT target) FROM ({SOURCE}) WHERE type = 'references' GROUP BY source HAVING count(DISTINCT target) >= 8")
def find_god_objects(spark, sf):
    return graph.god_objects(A.frame(spark, sf, A.LOOSE_NODES), A.frame(spark, sf, A.SOURCE_EDGES))


DEAD = f"SELECT id, kind, layer, file FROM ({LOOSE_N}) WHERE kind NOT IN ('endpoint', 'component') AND layer NOT IN ('controller', 'test') AND entry IS NULL AND id NOT IN (SELECT target FROM ({STAR}))"


@register("find_orphans", DEAD)
def find_orphans(spark, sf):
    return graph.dead_nodes(*pair(spark, sf, A.LOOSE_NODES, A.STAR_EDGES)).select("id", "kind", "layer", "file")


DEAD_FILES = f"WITH dead AS ({DEAD}), n AS ({LOOSE_N} UNION ALL SELECT 'probe:' || CAST(r_regionkey AS STRING), 'function', 'function', 'py', 'probe/dead.py', 1, 2, NULL, NULL, NULL FROM region), d AS (SELECT id FROM dead UNION ALL SELECT id FROM n WHERE file = 'probe/dead.py') SELECT file, count(*) AS nodes FROM n GROUP BY file HAVING bool_and(id IN (SELECT id FROM d))"


@register("dead_files", DEAD_FILES)
def dead_files(spark, sf):
    n, e = pair(spark, sf, A.LOOSE_NODES, A.STAR_EDGES)
    n = n.unionByName(A.frame(spark, sf, "SELECT 'probe:' || CAST(r_regionkey AS STRING) AS id, 'function' AS kind, 'function' AS layer, 'py' AS lang, 'probe/dead.py' AS file, 1 AS start_line, 2 AS end_line FROM {region}"), allowMissingColumns=True)
    return graph.dead_files(n, graph.dead_nodes(n, e))


@register("debt_summary", f"SELECT tag, markers, dead_nodes, dead_files FROM (SELECT tag, count(*) AS markers FROM ({DEBT}) GROUP BY ROLLUP (tag)), (SELECT count(*) AS dead_nodes FROM ({DEAD})), (SELECT count(*) AS dead_files FROM ({DEAD_FILES}))")
def debt_summary(spark, sf):
    marked = X.debt_markers(X.lines(A.files(spark, sf))).rollup("tag").agg(F.count("*").alias("markers"))
    dead = find_orphans(spark, sf).agg(F.count("*").alias("dead_nodes"))
    return marked.crossJoin(dead).crossJoin(dead_files(spark, sf).agg(F.count("*").alias("dead_files")))  # one row each


OVER = "SELECT 'part:' || CAST(p_partkey AS STRING) AS source, 'brand:' || p_brand AS target FROM {part} WHERE p_size <= 49"
SUBS = "SELECT 'part:' || CAST(p_partkey AS STRING) AS sub, 'brand:' || p_brand AS base, p_size FROM {part}"


@register("find_overridden", f"SELECT base AS id, count(DISTINCT sub) AS subclasses FROM ({A.text(SUBS)}) GROUP BY base HAVING count(DISTINCT sub) = (SELECT count(DISTINCT source) FROM ({A.text(OVER)}) WHERE target = base)")
def find_overridden(spark, sf):
    return graph.overridden(A.frame(spark, sf, OVER), A.frame(spark, sf, SUBS))


NAMED = "SELECT 'part:' || CAST(p_partkey AS STRING) AS id, p_name AS name, 'py' AS lang FROM {part} UNION ALL SELECT 'user:' || CAST(user_id AS STRING) || ':' || event_type, 'use' || upper(substr(event_type, 1, 1)) || substr(event_type, 2), 'js' FROM {events} UNION ALL SELECT 'x:' || CAST(r_regionkey AS STRING), CASE r_regionkey WHEN 0 THEN 'getInstance' WHEN 1 THEN 'make_order' WHEN 2 THEN 'OrderListener' WHEN 3 THEN 'useCart' ELSE 'createOrder' END, 'py' FROM {region}"


@register("detect_patterns", " UNION ALL ".join(f"SELECT id, '{k}' AS pattern FROM ({A.text(NAMED)}) WHERE regexp_matches(name, '{p}')" + (" AND lang = 'js'" if k == "react hook" else "") for k, p in graph.PATTERNS.items()))
def detect_patterns(spark, sf):
    return graph.detect_patterns(A.frame(spark, sf, NAMED))


#: Brands are declarations, types hold overload sets, regions are reached by name.
PRECISE_NODES = "SELECT DISTINCT 'brand:' || p_brand AS id, TRUE AS declaration, CAST(NULL AS STRING) AS ambiguous FROM {part} UNION ALL SELECT 'order:' || CAST(o_orderkey AS STRING), FALSE, CASE WHEN o_orderstatus = 'P' THEN 'Order.ship' END FROM {orders}"
PRECISE_EDGES = f"SELECT * FROM ({A.TREE_EDGES}) AS t UNION ALL SELECT 'order:' || CAST(o_orderkey AS STRING), 'customer:' || CAST(o_custkey AS STRING), 'http' FROM {{orders}} WHERE o_orderstatus = 'O'"


@register("precision_of", f"""WITH n AS ({A.text(PRECISE_NODES)}), e AS ({A.text(PRECISE_EDGES)}), w AS (
 SELECT source AS id, 'interface-dispatch' AS p FROM e JOIN n ON n.id = target WHERE type IN ('calls', 'http') AND declaration UNION SELECT source, 'name-matched' FROM e WHERE type = 'http' UNION SELECT id, 'overloads' FROM n WHERE ambiguous IS NOT NULL)
SELECT id, string_agg(p, ',' ORDER BY p) AS precision FROM w GROUP BY id""")
def precision_of(spark, sf):
    n = A.frame(spark, sf, PRECISE_NODES).withColumn("ambiguous", F.when(F.col("ambiguous").isNotNull(), F.array("ambiguous")))
    return graph.precision_of(n, A.frame(spark, sf, PRECISE_EDGES))


@register("census_edges", f"SELECT 'star' AS map, type, count(*) AS edges FROM ({STAR}) GROUP BY type UNION ALL SELECT 'tree', type, count(*) FROM ({TREE}) GROUP BY type")
def census_edges(spark, sf):
    both = A.frame(spark, sf, A.STAR_EDGES).withColumn("map", F.lit("star")).unionByName(A.frame(spark, sf, A.TREE_EDGES).withColumn("map", F.lit("tree")))
    return both.groupBy("map", "type").agg(F.count("*").alias("edges"))


@register("call_site_merge", f"""WITH s AS (SELECT *, list_sort(list_filter(string_split(arms, ','), lambda x: x <> '')) AS l FROM ({SITES})),
g AS (SELECT source, target, min(line) AS line, bool_or(loop) AS loop, bool_and(cond) AS cond, count(*) AS n FROM s GROUP BY source, target),
a AS (SELECT source, target, arm, count(*) AS k FROM s, unnest(l) AS r(arm) GROUP BY ALL)
SELECT g.source, g.target, g.line, g.loop, g.cond, coalesce((SELECT string_agg(arm, ',' ORDER BY arm) FROM a WHERE a.source = g.source AND a.target = g.target AND a.k = g.n), '') AS arms FROM g""")
def call_site_merge(spark, sf):
    return graph.merge_call_sites(A.frame(spark, sf, A.SESSION_SITES))


@register("arms_intersect", f"""WITH s AS (SELECT source, string_split(arms, ',') AS l FROM ({SITES})), c AS (SELECT source, count(*) AS n FROM s GROUP BY source),
a AS (SELECT source, arm, count(*) AS k FROM s, unnest(l) AS r(arm) WHERE arm <> '' GROUP BY ALL)
SELECT c.source, count(arm) AS shared FROM c LEFT JOIN a ON a.source = c.source AND k = n GROUP BY c.source""")
def arms_intersect(spark, sf):
    merged = graph.merge_call_sites(A.frame(spark, sf, A.SESSION_SITES).withColumn("target", F.lit("*")))
    return merged.select("source", F.when(F.col("arms") == "", 0).otherwise(F.size(F.split("arms", ","))).cast("long").alias("shared"))


@register("call_order", f"SELECT source, target, line, dense_rank() OVER (PARTITION BY source ORDER BY line) AS step FROM (SELECT source, target, min(line) AS line FROM ({SITES}) GROUP BY source, target)")
def call_order(spark, sf):
    from pyspark.sql import Window

    merged = graph.merge_call_sites(A.frame(spark, sf, A.SESSION_SITES))
    return merged.select("source", "target", "line", F.dense_rank().over(Window.partitionBy("source").orderBy("line")).cast("long").alias("step"))


def walk(edges: str, start: str, back: bool, keep: bool, depth: int = 99) -> str:
    """DuckDB: (id, dist) of what start (a statement giving id) reaches."""
    a, b = ("target", "source") if back else ("source", "target")
    first = f"SELECT id, 0 AS dist FROM ({start})"
    return f"""WITH RECURSIVE e AS (SELECT DISTINCT {a} AS a, {b} AS b FROM ({edges})), r(id, dist) AS ({first} UNION SELECT e.b, r.dist + 1 FROM r JOIN e ON e.a = r.id WHERE r.dist < {depth})
SELECT id, min(dist) AS dist FROM r {'' if keep else 'WHERE dist > 0'} GROUP BY id"""


@register("impact_of", walk(STAR, "SELECT 'region:0' AS id", True, False))
def impact_of(spark, sf):
    adj = graph.adjacency(A.stored(spark, sf, A.STAR_EDGES))
    return paths.impact_of(adj, spark.sql("SELECT 'region:0' AS id"))


@register("hop_distance", walk(STAR, "SELECT 'customer:1' AS id", False, True))
def hop_distance(spark, sf):
    return paths.reach(graph.adjacency(A.stored(spark, sf, A.STAR_EDGES)), spark.sql("SELECT 'customer:1' AS id"))


@register("neighbors_k", walk(STAR, "SELECT 'supplier:1' AS id", True, False, 2))
def neighbors_k(spark, sf):
    return paths.impact_of(graph.adjacency(A.stored(spark, sf, A.STAR_EDGES)), spark.sql("SELECT 'supplier:1' AS id"), 2)


CHANGED = f"SELECT id FROM ({A.STAR_NODES}) AS n WHERE file = 'customers/building.java' OR file = 'places/nations.py'"


@register("impact_of_diff", walk(STAR, A.text(CHANGED), True, False))
def impact_of_diff(spark, sf):
    return paths.impact_of(graph.adjacency(A.stored(spark, sf, A.STAR_EDGES)), A.frame(spark, sf, CHANGED))


BLAST = "SELECT 'supplier:' || CAST(s_suppkey AS STRING) AS id FROM {supplier} WHERE s_acctbal < 0"


@register("blast_union", f"SELECT id FROM ({walk(STAR, A.text(BLAST), True, False)})")
def blast_union(spark, sf):
    return paths.impact_of(graph.adjacency(A.stored(spark, sf, A.STAR_EDGES)), A.frame(spark, sf, BLAST)).select("id")


@register("scan_git_diff", f"SELECT DISTINCT file FROM ({A.text(A.STAR_NODES)}) WHERE id IN (SELECT id FROM ({A.text(CHANGED)}))")
def scan_git_diff(spark, sf):
    from weftline.sources.readers import changed_files

    listing = "customers/building.java\nplaces/nations.py\n\n"  # as `git diff --name-only` prints it
    changed = changed_files(spark.createDataFrame([(listing,)], "value string"))
    return A.frame(spark, sf, A.STAR_NODES).join(changed, "file", "left_semi").select("file").distinct()


@register("shortest_path", f"""WITH RECURSIVE e AS (SELECT DISTINCT source AS a, target AS b FROM ({STAR})), r(id, path, hop) AS (
SELECT 'order:1', ['order:1'], 0 UNION ALL SELECT e.b, list_append(r.path, e.b), r.hop + 1 FROM r JOIN e ON e.a = r.id WHERE r.hop < 4 AND r.id <> 'region:0'),
best AS (SELECT path FROM r WHERE id = 'region:0' ORDER BY hop, path LIMIT 1) SELECT CAST(i - 1 AS INT) AS hop, path[i] AS id FROM best, unnest(range(1, len(path) + 1)) AS s(i)""")
def shortest_path(spark, sf):
    adj = graph.adjacency(A.stored(spark, sf, A.STAR_EDGES))
    return paths.shortest_path(adj, "order:1", "region:0")


@register("all_paths", f"""WITH RECURSIVE e AS (SELECT DISTINCT source AS a, target AS b FROM ({TRADE})), g AS (SELECT min(target) AS t, min(source) AS s FROM ({TRADE})), r(id, path, hops) AS (
SELECT s, [s], 0 FROM g UNION ALL SELECT e.b, list_append(r.path, e.b), r.hops + 1 FROM r JOIN e ON e.a = r.id, g WHERE r.hops < 6 AND r.id <> g.t AND NOT list_contains(r.path, e.b))
SELECT array_to_string(path, ' > ') AS path, hops FROM r, g WHERE id = t AND hops > 0""")
def all_paths(spark, sf):
    e = A.frame(spark, sf, A.TRADE_EDGES).persist()
    ends = e.agg(F.min("source"), F.min("target")).first()
    return paths.all_paths(graph.adjacency(e), ends[0], ends[1])


CLOSURE = """t AS (SELECT DISTINCT source AS a, target AS b FROM e), r AS (SELECT a, b FROM t UNION SELECT r.a, t.b FROM r JOIN t ON t.a = r.b)"""


def cycles_sql(edges: str, loops: bool) -> str:
    own = "UNION ALL SELECT DISTINCT 1, source FROM e WHERE source = target" if loops else ""
    return f"""WITH RECURSIVE e AS ({edges}), {CLOSURE}, m AS (SELECT x.a AS id, min(x.b) AS scc FROM r AS x JOIN r AS y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
SELECT count(*) AS size, string_agg(id, ',' ORDER BY id) AS members FROM (SELECT id, least(id, scc) AS scc FROM m) GROUP BY scc HAVING count(*) > 1 {own}"""


@register("find_cycles", cycles_sql(TRADE, True))
def find_cycles(spark, sf):
    return cycles.find_cycles(A.frame(spark, sf, A.TRADE_EDGES))


@register("find_cycles_session", cycles_sql(SESSION, False))
def find_cycles_session(spark, sf):
    n, e = pair(spark, sf, A.SESSION_NODES, A.SESSION_EDGES)
    return cycles.find_cycles(graph.app_edges(n, e))


@register("topo_rank", f"""WITH RECURSIVE e AS (SELECT DISTINCT source AS a, target AS b FROM ({STAR})), v AS (SELECT a AS id FROM e UNION SELECT b FROM e), r(id, d) AS (
SELECT id, 0 FROM v WHERE id NOT IN (SELECT b FROM e) UNION SELECT e.b, r.d + 1 FROM r JOIN e ON e.a = r.id) SELECT id, max(d) AS rank FROM r GROUP BY id""")
def topo_rank(spark, sf):
    return paths.topo_rank(graph.adjacency(A.stored(spark, sf, A.STAR_EDGES)))


HEALTH_SQL = f"""WITH RECURSIVE {app(SESSION_N, SESSION)}, {COUPLING}, g AS (SELECT DISTINCT source AS a, target AS b FROM app), r AS (SELECT a, b FROM g UNION SELECT r.a, g.b FROM r JOIN g ON g.a = r.b),
m AS (SELECT x.a AS id, min(x.b) AS scc FROM r AS x JOIN r AS y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
k AS (SELECT (SELECT count(DISTINCT least(id, scc)) FROM m) AS cycles,
 (SELECT count(*) FROM (SELECT DISTINCT source, target FROM app JOIN n AS s ON s.id = source JOIN n AS t ON t.id = target WHERE {RANK.format('t.layer')} < {RANK.format('s.layer')})) AS lv,
 (SELECT count(*) FROM c WHERE fan_in >= 5 AND fan_out >= 5) AS hubs,
 (SELECT count(*) FROM (SELECT DISTINCT source, target FROM app JOIN c AS s ON s.id = source JOIN c AS t ON t.id = target WHERE s.fan_in >= 5 AND s.instability < 0.3 AND t.instability > 0.7)) AS ww,
 (SELECT count(*) FROM (SELECT cls FROM n WHERE layer <> 'test' GROUP BY cls HAVING count(*) >= 12)) AS god,
 (SELECT 100.0 * count(*) FILTER (layer <> 'controller' AND id NOT IN (SELECT target FROM e)) / count(*) FROM n) AS dead,
 (SELECT count(*) FILTER (severity = 'high') * 10 + count(*) FILTER (severity = 'medium') * 4 + count(*) FILTER (severity = 'low') FROM ({FINDINGS} SELECT severity FROM f)) AS security),
d AS (SELECT least(24.0, 8 * cycles) AS d_cycles, least(16.0, 4 * lv) AS d_layers, least(12.0, 3 * hubs) AS d_coupling, least(8.0, 2 * ww) AS d_wrong_way, least(12.0, 3 * god) AS d_god,
 least(20.0, round_even(0.5 * dead, 0)) AS d_dead, least(30.0, security) AS d_security FROM k),
f AS (SELECT *, greatest(0.0, 100 - (d_cycles + d_layers + d_coupling + d_wrong_way + d_god + d_dead + d_security)) AS s FROM d)
SELECT CAST(d_cycles AS DOUBLE) AS d_cycles, CAST(d_layers AS DOUBLE) AS d_layers, CAST(d_coupling AS DOUBLE) AS d_coupling, CAST(d_wrong_way AS DOUBLE) AS d_wrong_way, CAST(d_god AS DOUBLE) AS d_god,
 CAST(d_dead AS DOUBLE) AS d_dead, CAST(d_security AS DOUBLE) AS d_security, CAST(s AS DOUBLE) AS score, CASE WHEN s >= 90 THEN 'A' WHEN s >= 80 THEN 'B' WHEN s >= 70 THEN 'C' WHEN s >= 60 THEN 'D' ELSE 'F' END AS grade FROM f"""


@register("health", HEALTH_SQL)
def health(spark, sf):
    n, e = pair(spark, sf, A.SESSION_NODES, A.SESSION_EDGES)
    a = graph.app_edges(n, e).persist()
    c = graph.coupling(n, a).persist()
    count = lambda df, name: df.agg(F.count("*").alias(name))
    dead = graph.dead_nodes(n, e).agg(F.count("*").alias("k")).crossJoin(n.agg(F.count("*").alias("all"))).select((100.0 * F.col("k") / F.col("all")).alias("dead_pct"))
    found = X.findings(X.lines(A.files(spark, sf))).agg(*[F.count_if(F.col("severity") == v).alias(k) for k, v in (("high", "high"), ("med", "medium"), ("low", "low"))]).persist()
    return graph.health({
        "cycles": count(cycles.find_cycles(a), "cycles"), "layer_violations": count(graph.layer_violations(n, a), "layer_violations"), "hubs": count(graph.hubs(c), "hubs"),
        "wrong_way": count(graph.wrong_way(c, a), "wrong_way"), "god_objects": count(graph.god_objects(n, e), "god_objects"), "dead_pct": dead,
        "high": found, "med": found, "low": found,
    })
