"""Text scans, ownership, clones and extraction on small files."""

from pyspark.sql import functions as F

from weftline.extract import python as P
from weftline.functions import text as X
from weftline.operators import clones, review


def files(spark, **texts):
    return spark.createDataFrame([(k.replace("__", "/") + ".py", "py", v) for k, v in texts.items()], "path string, lang string, text string")


def test_secrets_that_are_held(spark):
    values = ['k_api_key = "zq_live_77aa88bb"', "my_password = 'pa55!word9'", 'x = { access_token: "accessToken" }', 'reset_password = "/reset/it"', 'token_note = "some words here"', 'token: "top-bar-3"', 'token_event: "auth:token-gone"', 'api_key = "11112222-aaaa-4bbb-8ccc-123412341234"', 'api_key = os.environ["API_KEY_NAME"]']
    f = files(spark, src__a="\n".join(values))
    found = sorted(r["line_no"] for r in X.findings(X.lines(f)).where("rule = 'hardcoded_secret'").collect())
    assert found == [1, 2, 8]


def test_scan_skips_tests_comments_and_long_lines(spark):
    line = 'password = "abcd1234!x"'
    f = files(spark, tests__a=line, src__b="# " + line, src__c=line + " " * 500, src__d=line)
    assert [r["path"] for r in X.findings(X.lines(f)).collect()] == ["src/d.py"]


def test_look_behind_free_patterns(spark):
    f = files(spark, src__a="model.eval(x)\neval(x)\nx = exec (y)\nevaluate(x)\nnew Function (")
    assert [r["line_no"] for r in X.findings(X.lines(f)).where("rule = 'dangerous_eval'").orderBy("line_no").collect()] == [2, 3, 5]


def test_owner_is_the_smallest_range(spark):
    n = spark.createDataFrame([("f", "m/a.py", 10, 12), ("outer", "m/a.py", 9, 15), ("Entity", "m/b.py", None, None)], "id string, path string, start int, end int")
    f = spark.createDataFrame([("m/a.py", 11), ("m/a.py", 20), ("m/b.py", 400)], "path string, line_no int")
    assert {(r["path"], r["line_no"], r["owner"]) for r in review.owner_of(f, n).collect()} == {("m/a.py", 11, "f"), ("m/a.py", 20, None), ("m/b.py", 400, "Entity")}


def test_line_kinds_and_line_ends(spark):
    f = spark.createDataFrame([("a.py", "py", "x = 1\r\n\r\n# c\ry = 2"), ("b.js", "js", None)], "path string, lang string, text string")
    m = {r["path"]: (r["lines"], r["code"], r["comment"], r["blank"]) for r in X.line_metrics(X.lines(f)).collect()}
    assert m == {"a.py": (4, 2, 1, 1), "b.js": (1, 0, 0, 1)}


def test_paths_without_a_literal_link_nowhere(spark):
    rows = [("https://h.example/api/x/?q=1", "api/x"), ("/a/{id}/", "a/{}"), ("a/<int:id>", "a/{}"), ("/a/:id?", "a/{}"), ("${id}", None), ("/", None)]
    df = spark.createDataFrame(rows, "u string, want string").withColumn("got", X.norm_path(F.col("u")))
    assert df.where("not (got <=> want)").count() == 0


def test_suffix_links_only_when_unique(spark):
    calls = spark.createDataFrame([("f", "GET", "v1/orders/{}"), ("g", "GET", "v1/items")], "caller string, method string, path string")
    routes = spark.createDataFrame([("show", "GET", "orders/{}"), ("a", "GET", "items"), ("b", "GET", "v1/items")], "handler string, method string, path string")
    assert [(r[0], r[1]) for r in review.route_suffix(calls, routes).collect()] == [("f", "show")]


def test_copied_block_is_whole_lines_in_three_places(spark):
    block = "    total = 0\n    for row in rows[1:]:\n        if row.amount > 0 and row.kind == 'sale' and row.open:\n            total = total + row.amount * row.rate - row.fee\n            audit(row.name, total, 'sale', row.date)\n"
    other = block.replace("* row.rate", "/ row.rate")
    f = files(spark, src__one="def one(rows):\n    head = rows[0]\n" + block + "    return head, total\n", src__two="def two(rows, limit):\n    n = len(rows)\n" + block.replace("total", "sum2") + "    print(n, limit)\n    return 1\n", src__three="def three(rows, a, b, c):\n    seen = set()\n" + block.replace("row.", "rec.").replace("for row in", "for rec in") + "    yield seen\n", src__four="def four(rows):\n" + other)
    t = clones.tokens(X.lines(f))
    g = clones.kgrams(t)
    b = clones.blocks(t, g, clones.pairs(clones.winnow(g), clones.bodies(t)))
    found = {(r["path"], r["first_line"], r["last_line"]) for r in b.collect()}
    assert {("src/one.py", 3, 7), ("src/two.py", 3, 7), ("src/three.py", 3, 7)} <= found
    assert b.where("first_line = 3 and last_line = 7").select("shape").distinct().count() == 1


def test_shared_runs_share_a_fingerprint(spark):
    run = " ".join(f"a{i} +" if i % 3 else f"a{i} *" for i in range(15))
    f = files(spark, a="x = 1 ; " + run + " / 2 - y", b="z ( " + run + " ) % 7")
    p = clones.winnow(clones.kgrams(clones.tokens(X.lines(f))))
    assert p.groupBy("h").agg(F.countDistinct("path").alias("n")).where("n = 2").count() >= 1


def test_manifest_and_shared_names(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", None), ("v", None)], "path string, sha string")
    b = spark.createDataFrame([("x", "1"), ("y", "3"), ("w", "4"), ("v", None)], "path string, sha string")
    assert {(r[0], r[1]) for r in review.manifest_diff(a, b).collect()} == {("y", "modified"), ("w", "deleted"), ("z", "added")}
    n = spark.createDataFrame([("one.py", "main"), ("two.py", "main"), ("c.py", "Login"), ("d.py", "login"), ("e.py", "solo")], "path string, name string")
    assert {r["id"] for r in review.shared_ids(n).collect()} == {"one.main", "two.main", "c.Login", "d.login", "solo"}


SOURCE = '''
class Store:
    """Keeps things."""

    def save(self, item):
        return item


class Service(Store):
    def place(self, item, loud=False):
        for x in self.items():
            if x and loud or item:
                self.save(x)
        return helper(item)

    def items(self):
        return []


def helper(x):
    return x


helper(1)
'''


def test_python_extraction(spark):
    f = spark.createDataFrame([("a.py", "py", SOURCE), ("bad.py", "py", "def ("), ("n.py", "py", None)], "path string, lang string, text string")
    n, c = P.nodes(f), P.calls(f)
    assert {r["id"] for r in n.collect()} == {"Store", "Store.save", "Service", "Service.place", "Service.items", "helper"}
    place = n.where("id = 'Service.place'").first()
    assert (place["complexity"], place["depth"], place["params"]) == (5, 2, 2)
    up = spark.createDataFrame([("Service", "Store")], "cls string, base string")
    got = {(r["source"], r["target"], r["loop"], r["cond"]) for r in P.resolve(c, n, up).collect()}
    assert got == {("Service.place", "Service.items", False, False), ("Service.place", "Store.save", True, True), ("Service.place", "helper", False, False), ("a.py", "helper", False, False)}


def test_route_table(spark):
    text = "urlpatterns = [path('a/', views.show), re_path(r'^b$', views.Thing.as_view()), path('c/', include('x'))]"
    f = spark.createDataFrame([("shop/urls.py", text)], "path string, text string")
    assert {(r["path"], r["handler"]) for r in P.route_tables(f).collect()} == {("a/", "show"), ("^b$", "Thing")}
