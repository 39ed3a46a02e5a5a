"""Queries over files, lines, logs and routes made from the relational tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import clones, find, review, sequences
from weftline.plans.registry import register
from weftline.sources import adapters as A
from weftline.sources import readers

FILES, LINES, COMMITS = A.text(A.FILES_SQL), A.text(A.LINES_SQL), A.text(A.COMMITS)


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def m(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {q(pattern)})"


def lines(spark, sf):
    return X.lines(A.files(spark, sf))


@register("scan_files", f"SELECT path, lang, length(text) AS chars FROM ({FILES}) WHERE NOT {m('path', X.SKIP_DIRS)}")
def scan_files(spark, sf):
    return A.files(spark, sf).where(~F.col("path").rlike(X.SKIP_DIRS)).select("path", "lang", F.length("text").cast("long").alias("chars"))


@register("skip_dirs", f"SELECT path FROM ({FILES}) WHERE {m('path', X.SKIP_DIRS)}")
def skip_dirs(spark, sf):
    return A.files(spark, sf).where(F.col("path").rlike(X.SKIP_DIRS)).select("path")


@register("scan_lines", f"SELECT path, line_no, length(text) AS chars FROM ({LINES})")
def scan_lines(spark, sf):
    return lines(spark, sf).select("path", "line_no", F.length("text").cast("long").alias("chars"))


@register("lang_of", f"SELECT path, CASE regexp_extract(path, '\\.([A-Za-z]+)$', 1) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in X.LANGS.items())} END AS lang FROM ({FILES})")
def lang_of(spark, sf):
    return A.files(spark, sf).select("path", X.lang_of(F.col("path")).alias("lang"))


@register("is_test_path", f"SELECT path, {m('path', X.TEST_PATH)} AS is_test FROM ({FILES})")
def is_test_path(spark, sf):
    return A.files(spark, sf).select("path", F.col("path").rlike(X.TEST_PATH).alias("is_test"))


@register("is_test_content", f"SELECT path FROM ({FILES}) WHERE {m('text', X.TEST_TEXT)}")
def is_test_content(spark, sf):
    return A.files(spark, sf).where(F.col("text").rlike(X.TEST_TEXT)).select("path")


def _log(spark, sf):
    """The commits as numbered lines of a log."""
    c = A.frame(spark, sf, A.COMMITS)
    head = F.concat(F.lit("\x01"), "hash", F.lit("|"), "author", F.lit("|"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    row = F.concat_ws("\t", F.col("insertions").cast("string"), F.col("deletions").cast("string"), "path")
    return c.select(F.col("hash").alias("log_id"), F.posexplode(F.array(head, F.lit(""), row)).alias("line_no", "value"))


@register("scan_git_log", COMMITS)
def scan_git_log(spark, sf):
    log = readers.git_log(_log(spark, sf))
    return log.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register("file_churn", f"SELECT path, count(DISTINCT hash) AS commits, CAST(sum(insertions) AS BIGINT) AS insertions, CAST(sum(deletions) AS BIGINT) AS deletions, min(ts) AS first_ts, max(ts) AS last_ts FROM ({COMMITS}) GROUP BY path")
def file_churn(spark, sf):
    return review.file_churn(A.frame(spark, sf, A.COMMITS))


@register("date_functions", f"SELECT path, min(ts) AS first_ts, max(ts) AS last_ts FROM ({COMMITS}) GROUP BY path")
def date_functions(spark, sf):
    return review.file_churn(A.frame(spark, sf, A.COMMITS)).select("path", "first_ts", "last_ts")


@register("file_authors", f"SELECT path, author, count(DISTINCT hash) AS commits FROM ({COMMITS}) GROUP BY path, author")
def file_authors(spark, sf):
    return review.file_authors(A.frame(spark, sf, A.COMMITS))


OWNER = f"SELECT path, author AS owner FROM (SELECT path, author, row_number() OVER (PARTITION BY path ORDER BY count(DISTINCT hash) DESC, author) AS r FROM ({COMMITS}) GROUP BY path, author) WHERE r = 1"


@register("file_owner", OWNER)
def file_owner(spark, sf):
    return review.file_owner(A.frame(spark, sf, A.COMMITS))


EVENT_NODES = "SELECT DISTINCT 'u' || CAST(user_id AS STRING) || ':' || event_type AS id, 'src/' || event_type || '.py' AS file FROM {events}"
EVENT_N, SESSION = A.text(EVENT_NODES), A.text(A.SESSION_EDGES)
CHURN = f"SELECT path, count(DISTINCT hash) AS commits FROM ({COMMITS}) GROUP BY path"


@register("churn_join", f"WITH n AS (SELECT id, 'app/' || file AS file FROM ({EVENT_N})), c AS ({CHURN}) SELECT n.id, c.path, c.commits FROM n JOIN c ON n.file = 'app/' || c.path")
def churn_join(spark, sf):
    n = A.frame(spark, sf, EVENT_NODES).withColumn("file", F.concat(F.lit("app/"), "file"))
    return review.churn_join(review.file_churn(A.frame(spark, sf, A.COMMITS)), n)


@register("hotspots", f"""WITH n AS ({EVENT_N}), c AS ({CHURN}), e AS ({SESSION}), i AS (SELECT target AS id, count(*) AS k FROM e GROUP BY target), o AS (SELECT source AS id, count(*) AS k FROM e GROUP BY source)
SELECT n.id, commits, coalesce(i.k, 0) AS fan_in, coalesce(o.k, 0) AS fan_out, commits * (1 + coalesce(i.k, 0) + coalesce(o.k, 0)) AS risk FROM n JOIN c ON path = file LEFT JOIN i ON i.id = n.id LEFT JOIN o ON o.id = n.id""")
def hotspots(spark, sf):
    return review.hotspots(review.file_churn(A.frame(spark, sf, A.COMMITS)), A.frame(spark, sf, A.SESSION_EDGES), A.frame(spark, sf, EVENT_NODES))


@register("insights_summary", f"SELECT count(DISTINCT path) AS files_with_history, count(DISTINCT hash) AS commits, count(DISTINCT author) AS authors FROM ({COMMITS})")
def insights_summary(spark, sf):
    return A.frame(spark, sf, A.COMMITS).agg(F.countDistinct("path").alias("files_with_history"), F.countDistinct("hash").alias("commits"), F.countDistinct("author").alias("authors"))


TRIM = "trim(regexp_replace(text, '\\s', ' ', 'g'))"
KIND = f"CASE WHEN {TRIM} = '' THEN 'blank' WHEN (lang IN ('py', 'ruby', 'elixir') AND starts_with({TRIM}, '#')) OR (lang NOT IN ('py', 'ruby', 'elixir') AND (starts_with({TRIM}, '//') OR starts_with({TRIM}, '/*') OR starts_with({TRIM}, '*'))) THEN 'comment' ELSE 'code' END"
METRICS = f"SELECT path, lang, count(*) AS lines, count(*) FILTER (k = 'code') AS code, count(*) FILTER (k = 'comment') AS comment, count(*) FILTER (k = 'blank') AS blank FROM (SELECT path, lang, {KIND} AS k FROM ({LINES})) GROUP BY path, lang"


@register("line_metrics", METRICS)
def line_metrics(spark, sf):
    return X.line_metrics(lines(spark, sf))


@register("census", f"SELECT lang, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, round(sum(comment) / sum(lines), 6) AS comment_ratio FROM ({METRICS}) GROUP BY ROLLUP (lang)")
def census(spark, sf):
    return X.line_metrics(lines(spark, sf)).rollup("lang").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"), F.round(F.sum("comment") / F.sum("lines"), 6).alias("comment_ratio"))


@register("top_files", f"SELECT path, lines FROM ({METRICS}) ORDER BY lines DESC, path LIMIT 10")
def top_files(spark, sf):
    return X.line_metrics(lines(spark, sf)).select("path", "lines").orderBy(F.desc("lines"), "path").limit(10)


@register("top_loc", f"SELECT id, end_line - start_line + 1 AS loc FROM ({A.text(A.STAR_NODES)}) ORDER BY loc DESC, id LIMIT 10")
def top_loc(spark, sf):
    return A.frame(spark, sf, A.STAR_NODES).select("id", (F.col("end_line") - F.col("start_line") + 1).alias("loc")).orderBy(F.desc("loc"), "id").limit(10)


SCANNED = f"length(text) <= 500 AND NOT {m('path', X.QUIET_PATH)} AND NOT {m('path', X.TEST_PATH)} AND NOT {m('text', X.COMMENT_LINE)}"
CRED = f"{m('text', X.CREDENTIAL)} AND NOT {m(f'regexp_extract(text, {q(X.CREDENTIAL)}, 3)', X.NAMES)} AND NOT {m('text', X.PLACEHOLDER)} AND lower(regexp_extract(text, {q(X.CREDENTIAL)}, 3)) <> lower(regexp_extract(text, {q(X.CREDENTIAL)}, 1))"
FINDINGS = f"WITH l AS (SELECT path, line_no, text FROM ({LINES}) WHERE {SCANNED}), f AS (SELECT path, line_no, 'hardcoded_secret' AS rule, 'high' AS severity, text FROM l WHERE {CRED}" + "".join(f" UNION ALL SELECT path, line_no, '{r}', '{s}', text FROM l WHERE {' AND '.join(m('text', p) for p in ps)}" for r, (s, ps) in X.RULES.items()) + ") "


def findings(spark, sf):
    return X.findings(lines(spark, sf))


@register("sec_findings", FINDINGS + "SELECT * FROM f")
def sec_findings(spark, sf):
    return findings(spark, sf)


@register("sec_credential", f"SELECT path, line_no, regexp_extract(text, {q(X.CREDENTIAL)}, 1) AS key FROM ({LINES}) WHERE {m('text', X.CREDENTIAL)}")
def sec_credential(spark, sf):
    return lines(spark, sf).where(F.col("text").rlike(X.CREDENTIAL)).select("path", "line_no", F.regexp_extract("text", X.CREDENTIAL, 1).alias("key"))


@register("sec_names_not_holds", f"SELECT path, line_no, {CRED} AS holds FROM ({LINES}) WHERE {m('text', X.CREDENTIAL)}")
def sec_names_not_holds(spark, sf):
    return lines(spark, sf).where(F.col("text").rlike(X.CREDENTIAL)).select("path", "line_no", X.credential(F.col("text")).alias("holds"))


@register("sec_placeholder", f"SELECT path, line_no FROM ({LINES}) WHERE {m('text', X.CREDENTIAL)} AND {m('text', X.PLACEHOLDER)}")
def sec_placeholder(spark, sf):
    return lines(spark, sf).where(F.col("text").rlike(X.CREDENTIAL) & F.col("text").rlike(X.PLACEHOLDER)).select("path", "line_no")


@register("sec_line_filter", f"SELECT path, line_no FROM ({LINES}) WHERE {SCANNED}")
def sec_line_filter(spark, sf):
    return X.scanned(lines(spark, sf)).select("path", "line_no")


@register("sec_redact", FINDINGS + """SELECT path, line_no, rule, regexp_replace(text, '(["''])([^"'']{3})[^"'']{5,}(["''])', '\\1\\2...redacted\\3', 'g') AS snippet FROM f""")
def sec_redact(spark, sf):
    return findings(spark, sf).select("path", "line_no", "rule", X.redact(F.col("text")).alias("snippet"))


def _one(name: str, rule: str):
    @register(name, f"SELECT path, line_no FROM ({LINES}) WHERE {' AND '.join(m('text', p) for p in X.RULES[rule][1])}")
    def one(spark, sf):
        df = lines(spark, sf)
        for p in X.RULES[rule][1]:
            df = df.where(F.col("text").rlike(p))
        return df.select("path", "line_no")


for _name, _rule in {"sec_aws": "aws_key", "sec_pem": "private_key", "sec_sql_injection": "sql_injection", "sec_eval": "dangerous_eval", "sec_html_sink": "html_sink", "sec_debug": "debug_statement"}.items():
    _one(_name, _rule)


READ = f"NOT {m('path', X.QUIET_PATH)} AND NOT {m('path', X.TEST_PATH)}"


@register("sec_summary", FINDINGS + f"SELECT severity, rule, n, files_scanned, files_skipped FROM (SELECT severity, rule, count(*) AS n FROM f GROUP BY GROUPING SETS ((severity), (rule), ())), (SELECT count(*) FILTER ({READ}) AS files_scanned, count(*) FILTER (NOT ({READ})) AS files_skipped FROM ({FILES}))")
def sec_summary(spark, sf):
    n = findings(spark, sf).groupingSets([["severity"], ["rule"], []], "severity", "rule").agg(F.count("*").alias("n")).select("severity", "rule", "n")
    skipped = F.col("path").rlike(X.QUIET_PATH) | F.col("path").rlike(X.TEST_PATH)
    return n.crossJoin(A.files(spark, sf).agg(F.count_if(~skipped).alias("files_scanned"), F.count_if(skipped).alias("files_skipped")))  # one row


#: Nodes of a file: the whole of it without a range, its first lines, and the second line within them.
RANGES = f"SELECT path || '#file' AS id, path, CAST(NULL AS INT) AS start, CAST(NULL AS INT) AS \"end\" FROM ({FILES}) WHERE lang <> 'py' UNION ALL SELECT path || '#head', path, 1, 3 FROM ({FILES}) UNION ALL SELECT path || '#second', path, 2, 2 FROM ({FILES})"


@register("owner_of", FINDINGS + f", n AS ({RANGES}) SELECT f.path, f.line_no, f.rule, min_by(id, row(coalesce(\"end\" - start, 2147483647), id)) AS owner FROM f LEFT JOIN n ON f.path = n.path AND (start IS NULL OR line_no BETWEEN start AND \"end\") GROUP BY ALL")
def owner_of(spark, sf):
    f = A.files(spark, sf).select("path", "lang")
    none = F.lit(None).cast("int")
    n = f.where("lang <> 'py'").select(F.concat("path", F.lit("#file")).alias("id"), "path", none.alias("start"), none.alias("end"))
    for tag, a, b in (("#head", 1, 3), ("#second", 2, 2)):
        n = n.unionByName(f.select(F.concat("path", F.lit(tag)).alias("id"), "path", F.lit(a).alias("start"), F.lit(b).alias("end")))
    return review.owner_of(findings(spark, sf).select("path", "line_no", "rule"), n)


PART = "CASE WHEN lang IN ('py', 'ruby', 'elixir') THEN regexp_extract(text, '#(.*)$', 1) ELSE regexp_extract(text, '(//|/\\*|^\\s*\\*)(.*)$', 2) END"
DEBT = f"SELECT path, line_no, tag FROM (SELECT path, line_no, regexp_extract({PART}, {q(X.DEBT)}, 1) AS tag FROM ({LINES})) WHERE tag <> ''"


@register("debt_markers", DEBT)
def debt_markers(spark, sf):
    return X.debt_markers(lines(spark, sf))


IDENTS = "SELECT DISTINCT path, ident FROM (SELECT 'tests/test_' || CAST(conv_id AS STRING) || '.py' AS path, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS ident FROM conversations)"
NAMED = "SELECT 'doc:' || CAST(doc_id AS STRING) AS id, regexp_extract(text, '[A-Za-z_][A-Za-z0-9_]*', 0) AS name, CASE WHEN lang = 'en' THEN 'the' END AS cls FROM {documents}"
SEEN = f"SELECT DISTINCT n.id, i.path FROM ({A.text(NAMED)}) AS n JOIN ({IDENTS}) AS i ON i.ident = n.name WHERE n.cls IS NULL OR (i.path, n.cls) IN (SELECT path, ident FROM ({IDENTS}))"


def idents(spark, sf):
    c = A.table(spark, sf, "conversations").select(F.concat(F.lit("tests/test_"), F.col("conv_id").cast("string"), F.lit(".py")).alias("path"), "text")
    return c.select("path", F.explode(X.identifiers(F.col("text"))).alias("ident")).distinct()


def named(spark, sf):
    return A.frame(spark, sf, NAMED)


@register("ident_set", IDENTS)
def ident_set(spark, sf):
    return idents(spark, sf)


@register("tests_join", SEEN)
def tests_join(spark, sf):
    return review.tests_join(named(spark, sf), idents(spark, sf))


@register("unreferenced", f"SELECT id FROM ({A.text(NAMED)}) WHERE id NOT IN (SELECT id FROM ({SEEN}))")
def unreferenced(spark, sf):
    open_ = review.tested(named(spark, sf), idents(spark, sf)).where("not hit")
    return open_.select(F.explode(F.expr("array_repeat(id, cast(nodes as int))")).alias("id"))


@register("tests_summary", f"SELECT test_files, considered, referenced, considered - referenced AS unreferenced, round(100.0 * referenced / considered, 1) AS referenced_pct FROM (SELECT (SELECT count(DISTINCT path) FROM ({IDENTS})) AS test_files, count(*) AS considered, count(*) FILTER (id IN (SELECT id FROM ({SEEN}))) AS referenced FROM ({A.text(NAMED)}))")
def tests_summary(spark, sf):
    n, i = named(spark, sf), idents(spark, sf)
    t = review.tested(n, i).agg(F.coalesce(F.sum("nodes"), F.lit(0)).alias("considered"), F.coalesce(F.sum(F.when(F.col("hit") & F.col("id").isNotNull(), F.col("nodes"))), F.lit(0)).alias("referenced"))
    both = t.crossJoin(i.agg(F.countDistinct("path").alias("test_files")))  # one row each
    return both.select("test_files", "considered", "referenced", (F.col("considered") - F.col("referenced")).alias("unreferenced"), F.round(100.0 * F.col("referenced") / F.col("considered"), 1).alias("referenced_pct"))


NOW = f"SELECT path, substr(sha1(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g')), 1, 12) AS sha FROM ({FILES})"
#: The cached manifest: one source is not there yet, one is gone by now, one has changed.
OLD = f"SELECT CASE WHEN starts_with(path, 'src1/') THEN 'old/' || path ELSE path END AS path, CASE WHEN starts_with(path, 'src2/') THEN 'stale' ELSE sha END AS sha FROM ({NOW})"
DIFF = f"SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM ({NOW}) AS n FULL JOIN ({OLD}) AS o ON n.path = o.path WHERE o.path IS NULL OR n.path IS NULL OR n.sha IS DISTINCT FROM o.sha"


def manifests(spark, sf):
    now = A.files(spark, sf).select("path", X.sha1_12(F.col("text")).alias("sha"))
    old = now.select(F.when(F.col("path").startswith("src1/"), F.concat(F.lit("old/"), "path")).otherwise(F.col("path")).alias("path"), F.when(F.col("path").startswith("src2/"), "stale").otherwise(F.col("sha")).alias("sha"))
    return now, old


@register("sha1_12", NOW)
def sha1_12(spark, sf):
    return manifests(spark, sf)[0]


@register("manifest_diff", DIFF)
def manifest_diff(spark, sf):
    return review.manifest_diff(*manifests(spark, sf))


def _change(kind: str):
    @register(f"manifest_{kind}", f"SELECT path FROM ({DIFF}) WHERE change = '{kind}'")
    def change(spark, sf):
        return review.manifest_diff(*manifests(spark, sf)).where(F.col("change") == kind).select("path")


for _kind in ("added", "deleted", "modified"):
    _change(_kind)


#: Grammars by language, one of another version by now; the root that was scanned has another name.
GRAMMARS, OLD_GRAMMARS = "SELECT DISTINCT lang, 'v2' AS version FROM {documents}", "SELECT DISTINCT lang, CASE WHEN lang = 'en' THEN 'v1' ELSE 'v2' END AS version FROM {documents}"


@register("freshness", f"""WITH r AS (SELECT change AS reason FROM ({DIFF}) UNION ALL SELECT 'grammar drift' FROM ({A.text(GRAMMARS)}) AS n JOIN ({A.text(OLD_GRAMMARS)}) AS o ON n.lang = o.lang AND n.version <> o.version
 UNION ALL SELECT 'source root moved' WHERE NOT EXISTS (SELECT * FROM (SELECT DISTINCT source AS root FROM documents) JOIN (SELECT DISTINCT 'was/' || source AS root FROM documents) USING (root)))
SELECT count(*) > 0 AS stale, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason), '') AS reasons FROM r""")
def freshness(spark, sf):
    roots = A.table(spark, sf, "documents").select(F.col("source").alias("root")).distinct()
    return review.freshness(*manifests(spark, sf), A.frame(spark, sf, GRAMMARS), A.frame(spark, sf, OLD_GRAMMARS), roots, roots.select(F.concat(F.lit("was/"), "root").alias("root")))


NAMES_SQL = f"SELECT DISTINCT path, regexp_extract(text, '[A-Za-z_][A-Za-z0-9_]*', 0) AS name FROM ({FILES})"


@register("shared_ids", f"""WITH n AS ({NAMES_SQL}), s AS (SELECT *, regexp_extract(path, '([^/]+?)(\\.[^./]*)?$', 1) AS stem FROM n),
k AS (SELECT lower(name) AS l, count(DISTINCT path) AS files FROM n GROUP BY l), t AS (SELECT lower(name) AS l, lower(stem) AS st, count(*) AS same FROM s GROUP BY l, st)
SELECT CASE WHEN files = 1 THEN name WHEN same = 1 THEN stem || '.' || name ELSE regexp_replace(path, '\\.[^./]*$', '') || '.' || name END AS id, path, name FROM s JOIN k ON k.l = lower(name) JOIN t ON t.l = lower(name) AND t.st = lower(stem)""")
def shared_ids(spark, sf):
    return review.shared_ids(A.files(spark, sf).select("path", F.regexp_extract("text", X.IDENT, 0).alias("name")))


def norm(c: str) -> str:
    c = f"regexp_replace(regexp_replace({c}, '^[a-z]+://[^/]*', '', 'g'), '[?#].*$', '', 'g')"
    c = f"regexp_replace({c}, '\\$?\\{{[^}}]*\\}}|<[^>]*>|(^|/):[A-Za-z_]\\w*\\??', '\\1{{}}', 'g')"
    c = f"regexp_replace(regexp_replace({c}, '/+', '/', 'g'), '^/|/$', '', 'g')"
    return f"CASE WHEN regexp_replace({c}, '[{{}}/]', '', 'g') <> '' THEN {c} END"


URLS = "SELECT url FROM pages UNION ALL SELECT '/api/orders/{id}/' UNION ALL SELECT 'api/orders/<int:id>' UNION ALL SELECT '/api/orders/:id?' UNION ALL SELECT '${id}' UNION ALL SELECT '/'"


@register("norm_path", f"SELECT url, {norm('url')} AS path FROM ({URLS})")
def norm_path(spark, sf):
    u = A.table(spark, sf, "pages").select("url").unionByName(spark.createDataFrame([("/api/orders/{id}/",), ("api/orders/<int:id>",), ("/api/orders/:id?",), ("${id}",), ("/",)], "url string"))
    return u.select("url", X.norm_path(F.col("url")).alias("path"))


HREFS = "SELECT DISTINCT 'page:' || CAST(page_id AS STRING) AS caller, 'GET' AS method, h AS url FROM pages, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS r(h)"
#: Calls that meet routes: the pages' own links meet none.
PROBED = "SELECT 'probe:' || CAST(page_id AS STRING) AS caller, 'GET' AS method, url FROM pages WHERE page_id % 3 = 0"
CALLS = f"SELECT DISTINCT caller || ' ' || url AS caller, method, {norm('url')} AS path FROM ({HREFS} UNION ALL {PROBED}) WHERE {norm('url')} IS NOT NULL"
ROUTES = f"SELECT DISTINCT 'page:' || CAST(page_id AS STRING) AS handler, 'GET' AS method, {norm('url')} AS path FROM pages WHERE {norm('url')} IS NOT NULL UNION ALL SELECT DISTINCT 'title:' || w, 'GET', w FROM (SELECT regexp_extract(url, '//([a-z]+)', 1) AS w FROM pages) WHERE w <> ''"
LONG = f"SELECT caller, method, 'v1/' || path AS path FROM ({CALLS})"


def hrefs(spark, sf):
    h = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("url")
    pages = A.table(spark, sf, "pages")
    c = pages.select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("p"), h)
    c = c.unionByName(pages.where("page_id % 3 = 0").select(F.concat(F.lit("probe:"), F.col("page_id").cast("string")).alias("p"), "url"))
    return c.select(F.concat("p", F.lit(" "), "url").alias("caller"), F.lit("GET").alias("method"), X.norm_path(F.col("url")).alias("path")).where("path is not null").distinct()


def routes(spark, sf):
    p = A.table(spark, sf, "pages")
    own = p.select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("handler"), F.lit("GET").alias("method"), X.norm_path(F.col("url")).alias("path")).where("path is not null").distinct()
    w = p.select(F.regexp_extract("url", "//([a-z]+)", 1).alias("w")).where("w <> ''").distinct()
    return own.unionByName(w.select(F.concat(F.lit("title:"), "w").alias("handler"), F.lit("GET").alias("method"), F.col("w").alias("path")))


@register("route_exact", f"SELECT DISTINCT caller, handler FROM ({CALLS}) JOIN ({ROUTES}) USING (method, path)")
def route_exact(spark, sf):
    return review.route_exact(hrefs(spark, sf), routes(spark, sf))


def sfx(rows: str, key: str) -> str:
    return f"SELECT {key}, method, array_to_string(p[i:], '/') AS path FROM (SELECT {key}, method, string_split(path, '/') AS p FROM ({rows})), unnest(range(1, len(p) + 1)) AS r(i)"


@register("route_suffix", f"WITH h AS (SELECT DISTINCT caller, handler FROM ({sfx(LONG, 'caller')}) JOIN ({ROUTES}) USING (method, path)) SELECT caller, min(handler) AS handler FROM h GROUP BY caller HAVING count(*) = 1")
def route_suffix(spark, sf):
    return review.route_suffix(hrefs(spark, sf).withColumn("path", F.concat(F.lit("v1/"), "path")), routes(spark, sf))


DEEP = f"SELECT handler, method, 'api/' || path AS path FROM ({ROUTES})"


@register("route_prefix", f"WITH h AS (SELECT DISTINCT caller, handler FROM ({CALLS}) JOIN ({sfx(DEEP, 'handler')}) USING (method, path) WHERE NOT starts_with(path, '{{')) SELECT caller, min(handler) AS handler FROM h GROUP BY caller HAVING count(*) = 1")
def route_prefix(spark, sf):
    return review.route_prefix(hrefs(spark, sf), routes(spark, sf).withColumn("path", F.concat(F.lit("api/"), "path")))


@register("compose_route", f"SELECT page_id, {norm('''lang || '/' || url''')} AS path FROM (SELECT page_id, 'api' AS lang, regexp_replace(url, '^[a-z]+://[^/]*', '') AS url FROM pages)")
def compose_route(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", X.norm_path(F.concat(F.lit("api/"), F.regexp_replace("url", "^[a-z]+://[^/]*", ""))).alias("path"))


LAYERS = [("ParcelDigest", "", ""), ("CrateLabelDto", "", ""), ("TideStore", "", ""), ("berth_repository", "", ""), ("HarbourDao", "", ""), ("QuayHandler", "Service", ""), ("NightSweep", "", "harbour/service/night/NightSweep.java"), ("BerthLimits", "", "harbour/properties/BerthLimits.java"), ("Winch", "", "harbour/common/Winch.java"), ("Ropes", "", "harbour/util/Ropes.java"), ("Repositioning", "", "")]


def _word(w: str) -> str:
    return m("name", f"({w})([^a-z]|$)")


def _folder(*w: str) -> str:
    return m("'/' || path", "/(" + "|".join(w) + ")/")


@register("infer_layer", "WITH x AS (SELECT source || c_name AS name, '' AS annotation, source || '/' || c_mktsegment || '/x.py' AS path FROM (SELECT c_name, c_mktsegment, CASE c_nationkey WHEN 1 THEN 'OrderService ' WHEN 2 THEN 'user_repo ' WHEN 3 THEN 'FeedController ' WHEN 4 THEN 'MailClient ' ELSE '' END AS source FROM customer) UNION ALL SELECT * FROM (VALUES " + ", ".join(str(r) for r in LAYERS) + f""") AS v(name, annotation, path)) SELECT name, path, coalesce(
 CASE WHEN annotation IN ('Controller', 'RestController', 'RestControllerAdvice') THEN 'controller' WHEN annotation = 'Service' THEN 'service' WHEN annotation = 'Repository' THEN 'repository' WHEN annotation = 'Entity' THEN 'model' END,
 CASE WHEN {_word('[Cc]ontroller|[Rr]outer|Resource')} THEN 'controller' WHEN {_word('[Ss]ervice|UseCase')} THEN 'service' WHEN {_word('[Rr]epository|[Rr]epo|[Ss]tore|[Dd]ao|Mapper')} THEN 'repository' WHEN {_word('[Cc]lient|Gateway')} THEN 'client' WHEN {_word('Dto|DTO|Entity|[Mm]odel')} THEN 'model' END,
 CASE WHEN {_folder('controller', 'controllers')} THEN 'controller' WHEN {_folder('service', 'services')} THEN 'service' WHEN {_folder('repository', 'repositories')} THEN 'repository' WHEN {_folder('response', 'request', 'dto', 'model', 'models')} THEN 'model' WHEN {_folder('properties', 'config')} THEN 'config' WHEN {_folder('util', 'utils')} THEN 'util' END, 'unknown') AS layer FROM x""")
def infer_layer(spark, sf):
    c = A.frame(spark, sf, "SELECT source || c_name AS name, '' AS annotation, source || '/' || c_mktsegment || '/x.py' AS path FROM (SELECT c_name, c_mktsegment, CASE c_nationkey WHEN 1 THEN 'OrderService ' WHEN 2 THEN 'user_repo ' WHEN 3 THEN 'FeedController ' WHEN 4 THEN 'MailClient ' ELSE '' END AS source FROM {customer}) AS x")
    c = c.unionByName(spark.createDataFrame(LAYERS, "name string, annotation string, path string"))
    return c.select("name", "path", X.infer_layer(F.col("name"), F.col("annotation"), F.col("path")).alias("layer"))


@register("doc_clean", f"SELECT path, trim(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^\\s*(/\\*\\*?|\\*/|\\*|///?|#)\\s?', '', 'g'), '</?[A-Za-z][^>]*>|\\*/', '', 'g'), '\\s+', ' ', 'g')) AS doc FROM ({FILES})")
def doc_clean(spark, sf):
    return A.files(spark, sf).select("path", X.doc_clean(F.col("text")).alias("doc"))


@register("bare_name", f"SELECT id, regexp_extract(regexp_replace(id, '\\(.*\\)$', ''), '([^.:/]+)$', 1) AS name FROM ({A.text(A.STAR_NODES)})")
def bare_name(spark, sf):
    from weftline.operators.graph import bare_name as bare

    return A.frame(spark, sf, A.STAR_NODES).select("id", bare(F.col("id")).alias("name"))


@register("json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json(spark, sf):
    return A.table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


# --- search --------------------------------------------------------------------------------

STAR_N, STAR = A.text(A.STAR_NODES), A.text(A.STAR_EDGES)


def search(query: str, where: str, limit: int | None = None, **filters):
    """A registered search; limit by id."""
    cut = f" ORDER BY id LIMIT {limit}" if limit else ""

    @register(query, f"SELECT id FROM (SELECT id FROM ({STAR_N}) AS n WHERE {where}{cut})")
    def run(spark, sf):
        return find.search(A.stored(spark, sf, A.STAR_NODES), A.stored(spark, sf, A.STAR_EDGES), limit=limit, **filters).select("id")


search("search_name", m("id", "(?i)SUPPLIER|region"), name="SUPPLIER|region")
search("search_doc", m("doc", "(?i)urgent"), doc="urgent")
search("search_layer", "layer = 'repository'", layer="repository")
search("search_kind", "kind = 'function'", kind="function")
search("search_file", "contains(file, '.java')", file=".java")
search("search_lang", "lang = 'go'", lang="go")
search("search_calls", f"id IN (SELECT source FROM ({STAR}) WHERE target = 'nation:3')", calls="nation:3")
search("search_called_by", f"id IN (SELECT target FROM ({STAR}) WHERE source = 'order:1')", called_by="order:1")
search("search_orphans", f"id NOT IN (SELECT target FROM ({STAR}))", orphans=True)
search("search_limit", "layer = 'service'", limit=find.LIMIT, layer="service")
search("search_all", f"layer = 'service' AND lang = 'java' AND contains(file, 'building') AND {m('id', '(?i)customer:1')} AND id IN (SELECT source FROM ({STAR}) WHERE target = 'nation:3')", limit=find.LIMIT, layer="service", lang="java", file="building", name="customer:1", calls="nation:3")


# --- clones --------------------------------------------------------------------------------

CODE = "CASE WHEN lang IN ('py', 'ruby', 'elixir') THEN regexp_replace(text, '#.*$', '', 'g') ELSE regexp_replace(text, '//.*$|/\\*.*?\\*/|^\\s*\\*.*$|/\\*.*$', '', 'g') END"
SHAPE = f"CASE WHEN regexp_matches(raw, '^[0-9\"'']') AND raw NOT IN ('''', '\"') THEN 'LIT' WHEN regexp_matches(raw, '^[A-Za-z_]') AND lower(raw) NOT IN ({', '.join(q(k) for k in X.KEYWORDS)}) THEN 'ID' ELSE raw END"
TOKS = f"SELECT path, row_number() OVER (PARTITION BY path ORDER BY line_no, k) AS pos, line_no, {SHAPE} AS tok FROM (SELECT path, line_no, k, l[k] AS raw FROM (SELECT path, line_no, regexp_extract_all({CODE}, {q(X.TOKEN)}) AS l FROM ({LINES})), unnest(range(1, len(l) + 1)) AS r(k))"
BODY = f"SELECT path, count(*) AS n, substr(sha1(string_agg(tok, ' ' ORDER BY pos)), 1, 12) AS hash, CAST(max(line_no) - min(line_no) + 1 AS BIGINT) AS loc FROM ({TOKS}) GROUP BY path HAVING count(*) >= 30"
CLUSTERS = f"SELECT hash, count(*) AS nodes, min(n) AS tokens, CAST(sum(loc) - max(loc) AS BIGINT) AS spare FROM ({BODY}) GROUP BY hash HAVING count(*) >= 2"
GRAMS = f"SELECT path, pos, ('0x' || substr(md5(array_to_string(run, ' ')), 1, 15))::BIGINT AS h FROM (SELECT path, pos, list(tok) OVER (PARTITION BY path ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS run FROM ({TOKS})) WHERE len(run) = 10"
PRINTS = f"SELECT DISTINCT path, b.p AS pos, -b.m AS h FROM (SELECT path, max({{'m': -h, 'p': pos}}) OVER w AS b, count(*) OVER w AS n FROM ({GRAMS}) WINDOW w AS (PARTITION BY path ORDER BY pos ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)) WHERE n = 21"
PAIRS = f"WITH p AS MATERIALIZED ({PRINTS}), b AS MATERIALIZED ({BODY}), hot AS (SELECT h FROM p GROUP BY h HAVING count(*) BETWEEN 2 AND 50), f AS (SELECT p.*, b.hash FROM p SEMI JOIN hot USING (h) LEFT JOIN b ON b.path = p.path) SELECT x.path AS a, y.path AS b, x.h, x.pos AS pa, y.pos AS pb FROM f AS x JOIN f AS y ON x.h = y.h AND (x.path < y.path OR (x.path = y.path AND y.pos - x.pos >= 30)) WHERE x.path = y.path OR x.hash IS NULL OR x.hash IS DISTINCT FROM y.hash"


def toks(spark, sf):
    return A.kept(spark, sf, "tokens", lambda: clones.tokens(lines(spark, sf)))


def grams(spark, sf):
    return A.kept(spark, sf, "grams", lambda: clones.kgrams(toks(spark, sf)))


def prints(spark, sf):
    return A.kept(spark, sf, "prints", lambda: clones.winnow(grams(spark, sf)))


@register("token_shape", f"SELECT path, CAST(pos AS INT) AS pos, line_no, tok FROM ({TOKS})")
def token_shape(spark, sf):
    return toks(spark, sf)


@register("body_hash", BODY)
def body_hash(spark, sf):
    return sequences.bodies(A.files(spark, sf))


@register("clone_clusters", CLUSTERS)
def clone_clusters(spark, sf):
    return clones.clusters(sequences.bodies(A.files(spark, sf)))


@register("clone_summary", f"SELECT count(*) AS clusters, CAST(coalesce(sum(nodes), 0) AS BIGINT) AS nodes_involved, CAST(coalesce(sum(tokens * (nodes - 1)), 0) AS BIGINT) AS duplicated_tokens, CAST(coalesce(sum(spare), 0) AS BIGINT) AS duplicated_lines FROM ({CLUSTERS})")
def clone_summary(spark, sf):
    c = clones.clusters(sequences.bodies(A.files(spark, sf)))
    return c.agg(F.count("*").alias("clusters"), F.coalesce(F.sum("nodes"), F.lit(0)).alias("nodes_involved"), F.coalesce(F.sum(F.col("tokens") * (F.col("nodes") - 1)), F.lit(0)).alias("duplicated_tokens"), F.coalesce(F.sum("spare"), F.lit(0)).alias("duplicated_lines"))


@register("kgrams", f"SELECT path, CAST(pos AS INT) AS pos, h FROM ({GRAMS})")
def kgrams(spark, sf):
    return grams(spark, sf)


@register("winnow_min", f"SELECT path, CAST(pos AS INT) AS pos, h FROM ({PRINTS})")
def winnow_min(spark, sf):
    return prints(spark, sf)


@register("fingerprints", f"SELECT h, count(*) AS places, count(DISTINCT path) AS files FROM ({PRINTS}) GROUP BY h HAVING count(*) BETWEEN 2 AND 50")
def fingerprints(spark, sf):
    return prints(spark, sf).groupBy("h").agg(F.count("*").alias("places"), F.countDistinct("path").alias("files")).where("places between 2 and 50")


@register("clone_pair", f"SELECT DISTINCT a, b FROM ({PAIRS})")
def clone_pair(spark, sf):
    return clones.pairs(prints(spark, sf), clones.bodies(toks(spark, sf))).select("a", "b").distinct()


BLOCKS = f"""WITH t AS MATERIALIZED ({TOKS}), g AS MATERIALIZED ({GRAMS}), seed AS MATERIALIZED (SELECT DISTINCT a, b, pa - pb AS d FROM ({PAIRS})),
same AS (SELECT a, b, d, x.pos AS pa FROM seed JOIN g AS x ON x.path = a JOIN g AS y ON y.path = b AND y.pos = x.pos - d AND y.h = x.h),
isle AS (SELECT *, pa - row_number() OVER (PARTITION BY a, b, d ORDER BY pa) AS i FROM same),
run AS (SELECT a, b, d, min(pa) AS s, CASE WHEN a = b THEN least(max(pa) + 9, min(pa) - d - 1) ELSE max(pa) + 9 END AS e FROM isle GROUP BY a, b, d, i),
both_ AS (SELECT a AS path, s, e FROM run UNION SELECT b, s - d, e - d FROM run),
line AS (SELECT path, line_no, min(pos) AS lo, max(pos) AS hi FROM t GROUP BY path, line_no),
whole AS (SELECT DISTINCT path, first_line, last_line, lo, hi FROM (SELECT path, s, e, min(line_no) AS first_line, max(line_no) AS last_line, min(lo) AS lo, max(hi) AS hi FROM both_ JOIN line USING (path) WHERE lo >= s AND hi <= e GROUP BY path, s, e) WHERE hi - lo + 1 >= 30)
SELECT substr(sha1(string_agg(tok, ' ' ORDER BY pos)), 1, 12) AS shape, w.path, first_line, last_line FROM whole AS w JOIN t ON t.path = w.path AND t.pos BETWEEN lo AND hi GROUP BY w.path, first_line, last_line"""


@register("clone_blocks", BLOCKS)
def clone_blocks(spark, sf):
    return sequences.blocks(A.kept(spark, sf, "packs", lambda: sequences.packed(A.files(spark, sf))))


# --- links, sets, outputs --------------------------------------------------------------------


@register("implements_link", f"""WITH RECURSIVE base AS (SELECT 'brand:' || p_brand AS a, 'type:' || substr(p_type, 1, 5) AS b FROM part UNION SELECT 'type:' || substr(p_type, 1, 5), 'root' FROM part), up AS (SELECT a, b FROM base UNION SELECT up.a, base.b FROM up JOIN base ON base.a = up.b),
method AS (SELECT DISTINCT 'brand:' || p_brand AS cls, 'size' || CAST(p_size AS STRING) AS name FROM part UNION SELECT DISTINCT 'type:' || substr(p_type, 1, 5), 'size' || CAST(p_size AS STRING) FROM part WHERE p_size > 25 UNION SELECT 'root', 'size1')
SELECT x.cls || '.' || x.name AS source, y.cls || '.' || y.name AS target FROM method AS x JOIN up ON up.a = x.cls JOIN method AS y ON y.cls = up.b AND y.name = x.name""")
def implements_link(spark, sf):
    from weftline.operators.inherit import ancestors
    from weftline.operators.inherit import implements_link as link

    base = A.frame(spark, sf, "SELECT DISTINCT 'brand:' || p_brand AS cls, 'type:' || substr(p_type, 1, 5) AS base FROM {part} UNION SELECT 'type:' || substr(p_type, 1, 5), 'root' FROM {part}")
    method = A.frame(spark, sf, "SELECT DISTINCT 'brand:' || p_brand AS cls, 'size' || CAST(p_size AS STRING) AS name FROM {part} UNION SELECT DISTINCT 'type:' || substr(p_type, 1, 5), 'size' || CAST(p_size AS STRING) FROM {part} WHERE p_size > 25 UNION SELECT 'root', 'size1'")
    return link(method, ancestors(base))


NOTES = "SELECT n_name AS name, concat('---', chr(10), 'kind: class', chr(10), '---', chr(10), 'see [[', r_name, ']] and [[', lower(n_name), '|it]] or [[nowhere]].') AS text FROM {nation} JOIN {region} ON n_regionkey = r_regionkey"


@register("read_vault", "SELECT n_name AS source, unnest([r_name, lower(n_name), 'nowhere']) AS target, 'class' AS kind FROM nation JOIN region ON n_regionkey = r_regionkey")
def read_vault(spark, sf):
    return readers.vault(A.frame(spark, sf, NOTES))


@register("wiki_link", "SELECT n_name AS source, t AS target, t = r_name AS known FROM nation JOIN region ON n_regionkey = r_regionkey, unnest([r_name, lower(n_name), 'nowhere']) AS u(t)")
def wiki_link(spark, sf):
    known = A.table(spark, sf, "region").select(F.col("r_name").alias("target"), F.lit(True).alias("k"))
    return readers.vault(A.frame(spark, sf, NOTES)).join(known, "target", "left").select("source", "target", F.coalesce("k", F.lit(False)).alias("known"))


@register("union_roots", f"SELECT source, target, type FROM ({STAR}) UNION SELECT source, target, type FROM ({A.text(A.TREE_EDGES)})")
def union_roots(spark, sf):
    return A.frame(spark, sf, A.STAR_EDGES).unionByName(A.frame(spark, sf, A.TREE_EDGES)).distinct()


@register("unresolved_vs_ext", f"SELECT i.path, i.ident FROM ({IDENTS}) AS i WHERE i.ident IN (SELECT name FROM ({A.text(NAMED)}))")
def unresolved_vs_ext(spark, sf):
    n = named(spark, sf).select(F.col("name").alias("ident"))
    return idents(spark, sf).join(n, "ident", "left_semi").select("path", "ident")


#: Nodes of the files, some without a body: declarations, and nodes whose file is gone.
BODIES = f"SELECT path || '#' || lang AS id, path AS file, lang = 'go' AS declaration FROM ({FILES}) UNION ALL SELECT 'gone:' || CAST(r_regionkey AS STRING), 'gone.py', FALSE FROM region"


@register("unmeasured_ids", f"SELECT id FROM ({BODIES}) WHERE declaration OR file NOT IN (SELECT path FROM ({FILES}))")
def unmeasured_ids(spark, sf):
    f = A.files(spark, sf)
    gone = A.table(spark, sf, "region").select(F.concat(F.lit("gone:"), F.col("r_regionkey").cast("string")).alias("id"), F.lit("gone.py").alias("file"), F.lit(False).alias("declaration"))
    n = f.select(F.concat("path", F.lit("#"), "lang").alias("id"), F.col("path").alias("file"), (F.col("lang") == "go").alias("declaration")).unionByName(gone)
    measured = n.where("not declaration").join(f.select(F.col("path").alias("file")), "file", "left_semi").select("id")
    return n.select("id").join(measured, "id", "left_anti")


@register("descriptions", "SELECT doc_id, coalesce(nullif(substr(text, 1, strpos(text, chr(10)) - 1), ''), 'doc ' || CAST(doc_id AS STRING)) AS description FROM documents WHERE strpos(text, chr(10)) > 0 UNION ALL SELECT doc_id, coalesce('label ' || CAST(l.quality AS STRING), 'doc ' || CAST(doc_id AS STRING)) FROM documents LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) AS l USING (doc_id) WHERE strpos(text, chr(10)) = 0 OR text IS NULL")
def descriptions(spark, sf):
    d = A.table(spark, sf, "documents").select("doc_id", F.when(F.instr("text", "\n") > 0, F.substring_index("text", "\n", 1)).alias("first"), (F.coalesce(F.instr("text", "\n"), F.lit(0)) > 0).alias("many"))
    cache = A.table(spark, sf, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sig = F.concat(F.lit("doc "), F.col("doc_id").cast("string"))
    cached = F.concat(F.lit("label "), F.col("quality").cast("string"))
    return d.join(cache, "doc_id", "left").select("doc_id", F.when(F.col("many"), F.coalesce(F.when(F.col("first") != "", F.col("first")), sig)).otherwise(F.coalesce(cached, sig)).alias("description"))
