"""Queries over Python sources generated from the events, and the composite outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.extract import python as P
from weftline.operators import cycles, graph, pack
from weftline.plans import q_text as T
from weftline.plans.q_graph import COUPLING, RANK, SESSION, SESSION_N, STAR, STAR_N, app, pair, star_coupling
from weftline.plans.registry import register
from weftline.sources import adapters as A
from weftline.streaming import churn

#: What each user does next, once each, and whether ever on a high value.
STEPS = f"SELECT source, target, bool_or(cond) AS cond FROM ({A.text(A.SESSION_SITES)}) GROUP BY source, target"
NAME = "upper({0}[1]) || split_part({0}, ':', 1)[2:] || '.' || split_part({0}, ':', 2)"
EVERY = "SELECT DISTINCT 'u' || CAST(user_id AS STRING) || ':' || event_type AS id FROM events"


def sources(spark, sf):
    """A class a user, a method an event type, a call for each next type, under a condition where its value was high."""
    s = A.frame(spark, sf, A.SESSION_SITES).groupBy("source", "target").agg(F.bool_or("cond").alias("cond"))
    every = A.frame(spark, sf, A.SESSION_NODES).select(F.col("id").alias("source"))
    call = F.concat(F.when(F.col("cond"), "        if self:\n            self.").otherwise("        self."), F.substring_index("target", ":", -1), F.lit("()\n"))
    body = every.join(s.select("source", "target", call.alias("call")), "source", "left").groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("target", "call"))), lambda x: x["call"]), "").alias("body"))
    method = F.concat(F.lit("    def "), F.substring_index("source", ":", -1), F.lit("(self):\n        pass\n"), "body")
    user = F.substring_index("source", ":", 1)
    cls = body.select(user.alias("user"), "source", method.alias("m")).groupBy("user").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source", "m"))), lambda x: x["m"]), "").alias("ms"))
    return cls.select(F.concat(F.lit("gen/"), "user", F.lit(".py")).alias("path"), F.lit("py").alias("lang"), F.concat(F.lit("class "), F.initcap("user"), F.lit(":\n"), "ms").alias("text"))


@register("extract_py", f"SELECT {NAME.format('id')} AS id, 'method' AS kind, 'gen/' || split_part(id, ':', 1) || '.py' AS path FROM ({EVERY}) UNION ALL SELECT DISTINCT upper(id[1]) || split_part(id, ':', 1)[2:], 'class', 'gen/' || split_part(id, ':', 1) || '.py' FROM ({EVERY})")
def extract_py(spark, sf):
    return P.nodes(sources(spark, sf)).select("id", "kind", "path")


COMPLEX = f"SELECT {NAME.format('id')} AS id, CAST(1 + count(*) FILTER (cond) AS INT) AS complexity FROM ({EVERY}) LEFT JOIN ({STEPS}) ON source = id GROUP BY id"


@register("complexity", COMPLEX)
def complexity(spark, sf):
    return P.nodes(sources(spark, sf)).where("kind = 'method'").select("id", "complexity")


@register("node_metrics", f"SELECT {NAME.format('id')} AS id, CAST(2 + count(target) + count(*) FILTER (cond) AS INT) AS loc, CAST(1 + count(*) FILTER (cond) AS INT) AS complexity, CAST(coalesce(max(cond::INT), 0) AS INT) AS depth, 0 AS params FROM ({EVERY}) LEFT JOIN ({STEPS}) ON source = id GROUP BY id")
def node_metrics(spark, sf):
    return P.nodes(sources(spark, sf)).where("kind = 'method'").select("id", (F.col("end") - F.col("start") + 1).alias("loc"), "complexity", "depth", "params")


@register("top_complexity", f"SELECT id, complexity FROM ({COMPLEX}) ORDER BY complexity DESC, id LIMIT 10")
def top_complexity(spark, sf):
    return complexity(spark, sf).orderBy(F.desc("complexity"), "id").limit(10)


@register("call_ctx", f"SELECT {NAME.format('source')} AS source, split_part(target, ':', 2) AS name, cond, FALSE AS loop FROM ({STEPS})")
def call_ctx(spark, sf):
    return P.calls(sources(spark, sf)).select("source", "name", "cond", "loop")


@register("resolve_calls", f"SELECT {NAME.format('source')} AS source, {NAME.format('target')} AS target, cond FROM ({STEPS}) WHERE source <> target")
def resolve_calls(spark, sf):
    s = sources(spark, sf)
    return P.resolve(P.calls(s), P.nodes(s)).select("source", "target", "cond")


@register("module_entry", "SELECT 'shop/urls' || CAST(r_regionkey AS STRING) || '.py' AS path, 'setup' AS name FROM region")
def module_entry(spark, sf):
    r = A.table(spark, sf, "region").select(F.concat(F.lit("shop/urls"), F.col("r_regionkey").cast("string"), F.lit(".py")).alias("path"), F.lit("py").alias("lang"), F.lit("def setup():\n    pass\n\n\nsetup()\n").alias("text"))
    return P.calls(r).where("source = path").select("path", "name")


@register("route_tables", "SELECT 'r' || CAST(n_regionkey AS STRING) || '/urls.py' AS file, 'nations/' || CAST(n_nationkey AS STRING) || '/' AS path, 'show_' || CAST(n_nationkey AS STRING) AS handler FROM nation")
def route_tables(spark, sf):
    n = A.table(spark, sf, "nation")
    line = F.concat(F.lit("    path('nations/"), F.col("n_nationkey").cast("string"), F.lit("/', views.show_"), F.col("n_nationkey").cast("string"), F.lit("),\n"))
    files = n.groupBy(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/urls.py")).alias("path")).agg(F.concat(F.lit("from django.urls import include, path\nurlpatterns = [\n    path('x/', include('y')),\n"), F.array_join(F.sort_array(F.collect_list(line)), ""), F.lit("]\n")).alias("text"))
    return P.route_tables(files)


#: Overload sets of the nations' regions, and calls of customers with known and unknown types.
OVERLOADS = "SELECT 'f' || CAST(n_regionkey AS STRING) || '(' || substr(n_name, 1, 1) || CASE WHEN n_nationkey % 2 = 0 THEN ',int' ELSE ',str' END || ')' AS id, 'f' || CAST(n_regionkey AS STRING) AS name, substr(n_name, 1, 1) || CASE WHEN n_nationkey % 2 = 0 THEN ',int' ELSE ',str' END AS params FROM {nation} UNION ALL SELECT 'f' || CAST(r_regionkey AS STRING) || '(int)', 'f' || CAST(r_regionkey AS STRING), 'int' FROM {region}"
OVERCALLS = "SELECT c_custkey AS site, 'c' || CAST(c_custkey % 97 AS STRING) AS source, 'f' || CAST(c_nationkey % 5 AS STRING) AS name, CASE WHEN c_custkey % 7 = 0 THEN 'str' ELSE substr(c_mktsegment, 1, 1) || CASE c_custkey % 3 WHEN 0 THEN ',int' WHEN 1 THEN ',?' ELSE ',str' END END AS args FROM {customer}"
SCORES = f"""o AS (SELECT id, name, string_split(params, ',') AS p FROM ({A.text(OVERLOADS)})), c AS (SELECT site, source, name, string_split(args, ',') AS a FROM ({A.text(OVERCALLS)})),
s AS (SELECT site, source, c.name, id, len(list_filter(list_zip(a, p), lambda x: x[1] = x[2])) AS score FROM c JOIN o ON o.name = c.name AND len(a) = len(p)), t AS (SELECT *, max(score) OVER (PARTITION BY site) AS top FROM s)"""


def overloads(spark, sf):
    from weftline.operators import dispatch

    c = A.frame(spark, sf, OVERCALLS).withColumn("args", F.transform(F.split("args", ","), lambda x: F.when(x != "?", x)))
    return dispatch.pick_overload(c, A.frame(spark, sf, OVERLOADS).withColumn("params", F.split("params", ",")))


@register("pick_overload", f"WITH {SCORES} SELECT site, any_value(source) AS source, any_value(id) AS target FROM t WHERE score = top GROUP BY site HAVING count(*) = 1")
def pick_overload(spark, sf):
    return overloads(spark, sf)[0]


@register("ambiguous_overloads", f"WITH {SCORES} SELECT DISTINCT source, name FROM (SELECT site, any_value(source) AS source, any_value(name) AS name FROM t WHERE score = top GROUP BY site HAVING count(*) > 1)")
def ambiguous_overloads(spark, sf):
    return overloads(spark, sf)[1]


#: Suppliers as beans of their nation, customers as places where a nation is injected.
BEANS = "SELECT 'b' || CAST(s_suppkey AS STRING) AS bean, s_name AS cls, 'Nation' || CAST(s_nationkey AS STRING) AS type, s_suppkey % 5 = 0 AS \"primary\", s_suppkey % 31 = 0 AS conditional FROM {supplier} UNION ALL SELECT 'solo' || CAST(r_regionkey AS STRING), 'Solo' || CAST(r_regionkey AS STRING), 'Nation' || CAST(100 + r_regionkey AS STRING), FALSE, r_regionkey = 3 FROM {region}"
INJECTED = "SELECT 'c' || CAST(c_custkey AS STRING) AS source, 'Nation' || CAST(CASE WHEN c_custkey % 4 = 0 THEN 100 + c_nationkey % 6 ELSE c_nationkey END AS STRING) AS type, CASE WHEN c_custkey % 3 = 0 THEN 'b' || CAST(c_custkey % 100 AS STRING) END AS qualifier FROM {customer}"


@register("spring_beans", f"""WITH b AS ({A.text(BEANS)}), i AS ({A.text(INJECTED)}), g AS (SELECT type, count(*) AS n, count(*) FILTER ("primary") AS primaries, bool_or(conditional) AS is_open, min(cls) AS only_, min(cls) FILTER ("primary") AS first_ FROM b GROUP BY type)
SELECT source, i.type, coalesce(CASE WHEN qualifier IS NOT NULL THEN (SELECT min(cls) FROM b WHERE b.type = i.type AND b.bean = i.qualifier) WHEN is_open THEN NULL WHEN n = 1 THEN only_ WHEN primaries = 1 THEN first_ END, i.type) AS target FROM i LEFT JOIN g ON g.type = i.type""")
def spring_beans(spark, sf):
    from weftline.operators import dispatch

    return dispatch.spring_beans(A.frame(spark, sf, INJECTED), A.frame(spark, sf, BEANS.replace('"', "`")))


@register("route_attached", "SELECT 'r0/urls.py' AS file, 'nations/' || CAST(n_nationkey AS STRING) || '/' AS path, 'show_' || CAST(n_nationkey AS STRING) AS handler, 'V.show_' || CAST(n_nationkey AS STRING) AS id FROM nation WHERE n_nationkey % 3 = 0")
def route_attached(spark, sf):
    n = A.table(spark, sf, "nation")
    key = F.col("n_nationkey").cast("string")
    routes = n.select(F.lit("r0/urls.py").alias("file"), F.concat(F.lit("nations/"), key, F.lit("/")).alias("path"), F.concat(F.lit("show_"), key).alias("handler"))
    once = n.where("n_nationkey % 3 < 2").select(F.concat(F.lit("V.show_"), key).alias("id"))
    return P.attached(routes, once.unionByName(n.where("n_nationkey % 3 = 1").select(F.concat(F.lit("W.show_"), key).alias("id"))))


@register("context_pack")
def context_pack(spark, sf):
    n, e = pair(spark, sf, A.STAR_NODES, A.STAR_EDGES)
    text = pack.context_pack("nation:3", n, e)
    return spark.createDataFrame([("nation:3", text, len(text))], "id string, text string, chars int")


GRADED = [("cycles", True), ("layer violations", True), ("god objects", True), ("orphans", True), ("shared helpers", False), ("coordinators", False), ("security", True), ("history", False), ("measures", False), ("debt", False), ("untested", False), ("copies", False)]
REPORT = f"""WITH RECURSIVE {app(SESSION_N, SESSION)}, {COUPLING}, g AS (SELECT DISTINCT source AS a, target AS b FROM app), r AS (SELECT a, b FROM g UNION SELECT r.a, g.b FROM r JOIN g ON g.a = r.b),
mm AS (SELECT x.a AS id, min(x.b) AS scc FROM r AS x JOIN r AS y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
SELECT 'cycles' AS section, TRUE AS graded, count(DISTINCT least(id, scc)) AS n FROM mm
UNION ALL SELECT 'layer violations', TRUE, count(*) FROM (SELECT DISTINCT source, target FROM app JOIN n AS s ON s.id = source JOIN n AS t ON t.id = target WHERE {RANK.format('t.layer')} < {RANK.format('s.layer')})
UNION ALL SELECT 'god objects', TRUE, count(*) FROM (SELECT cls FROM n GROUP BY cls HAVING count(*) >= 12)
UNION ALL SELECT 'orphans', TRUE, count(*) FROM n WHERE layer <> 'controller' AND id NOT IN (SELECT target FROM e)
UNION ALL SELECT 'shared helpers', FALSE, count(*) FROM c WHERE fan_in >= 10 AND instability <= 0.1
UNION ALL SELECT 'coordinators', FALSE, count(*) FROM c WHERE fan_out >= 10 AND fan_in <= 2
UNION ALL SELECT 'security', TRUE, count(*) FROM ({T.FINDINGS} SELECT * FROM f)
UNION ALL SELECT 'history', FALSE, count(DISTINCT path) FROM ({T.COMMITS})
UNION ALL SELECT 'measures', FALSE, count(*) FROM ({T.METRICS})
UNION ALL SELECT 'debt', FALSE, count(*) FROM ({T.DEBT})
UNION ALL SELECT 'untested', FALSE, count(*) FROM ({A.text(T.NAMED)}) WHERE id NOT IN (SELECT id FROM ({T.SEEN}))
UNION ALL SELECT 'copies', FALSE, count(*) FROM ({T.CLUSTERS})"""


def sections(spark, sf):
    n, e = pair(spark, sf, A.SESSION_NODES, A.SESSION_EDGES)
    a = graph.app_edges(n, e)
    c = graph.coupling(n, a)
    found = [cycles.find_cycles(a), graph.layer_violations(n, a), graph.god_objects(n, e), graph.dead_nodes(n, e), graph.shared_helpers(c), graph.coordinators(c)]
    found += [T.findings(spark, sf), A.frame(spark, sf, A.COMMITS).select("path").distinct(), T.line_metrics(spark, sf), T.debt_markers(spark, sf), T.unreferenced(spark, sf), T.clone_clusters(spark, sf)]
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), F.lit(graded).alias("graded"), "n") for (name, graded), df in zip(GRADED, found, strict=True)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@register("report", REPORT)
def report(spark, sf):
    return sections(spark, sf)


@register("graded_first", f"SELECT section, row_number() OVER (ORDER BY graded DESC, section) AS place FROM ({REPORT})")
def graded_first(spark, sf):
    from pyspark.sql import Window

    return sections(spark, sf).select("section", F.row_number().over(Window.orderBy(F.desc("graded"), "section")).cast("long").alias("place"))  # a row a section


@register("brief", f"WITH {app(STAR_N, STAR)}, {COUPLING} SELECT id, degree FROM c ORDER BY degree DESC, id LIMIT 5")
def brief(spark, sf):
    return star_coupling(spark, sf).select("id", "degree").orderBy(F.desc("degree"), "id").limit(5)


@register("sink_json", "SELECT CAST(to_json({'n_nationkey': n_nationkey, 'n_name': n_name}) AS VARCHAR) AS line FROM nation ORDER BY n_nationkey")
def sink_json(spark, sf):
    return pack.json_lines(A.table(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey")


@register("sink_markdown", "SELECT '- ' || event_type || ': ' || CAST(count(*) AS STRING) AS line FROM events GROUP BY event_type ORDER BY event_type")
def sink_markdown(spark, sf):
    return pack.markdown_lines(A.table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")), "event_type", "n", "event_type")


@register("stream_churn", "SELECT 'src/' || event_type || '.py' AS path, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS commits, CAST(sum(CAST(round(value) AS BIGINT)) AS BIGINT) AS insertions FROM events GROUP BY ALL")
def stream_churn(spark, sf):
    return churn.replay(spark, sf).select("path", F.date_format("start", "yyyy-MM-dd").alias("day"), "commits", "insertions")
