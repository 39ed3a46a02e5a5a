"""Copies within a file, declared receivers, overloads, beans, search, suffix joins."""

from weftline.extract import python as P
from weftline.functions import text as X
from weftline.operators import clones, dispatch, find, review
from weftline.sources import readers

BODY = ["    whole = 0", "    for {0} in {0}s:", "        if {0}.kind == 'dry' and {0}.weight > 10:", "            whole = whole + {0}.weight * {0}.price - {0}.toll", "    return round(whole, 2) + len({0}s) * 0"]


def test_a_block_copied_within_one_file(spark):
    text = [""] * 40
    for at, name, item in ((2, "sum_crates", "crate"), (12, "sum_barrels", "barrel"), (32, "sum_jars", "jar")):
        text[at - 1] = f"@timed_{at}" if at > 20 else f"x{at} = [{at}]" if at > 5 else "import os"
        text[at : at + 5] = [line.format(item) for line in BODY]
    text[22:27] = [line.format("sack").replace("*", "/") for line in BODY]
    f = spark.createDataFrame([("src/all.py", "py", "\n".join(text))], "path string, lang string, text string")
    t = clones.tokens(X.lines(f))
    g = clones.kgrams(t)
    pairs = clones.pairs(clones.winnow(g), clones.bodies(t))
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {("src/all.py", "src/all.py")}
    by_shape = {}
    for r in clones.blocks(t, g, pairs).collect():
        by_shape.setdefault(r["shape"], set()).add((r["first_line"], r["last_line"]))
    assert {(3, 7), (13, 17), (33, 37)} in by_shape.values()


def test_roots_are_walked(spark, tmp_path):
    for name, text in (("a/x.py", "import os\n"), ("a/b/y.ts", "let é = 1\n"), ("a/.next/z.js", "no\n"), ("a/readme", "no\n")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = readers.walk(spark, str(tmp_path)).collect()
    assert sorted((r["path"].rsplit("/", 1)[1], r["lang"], r["text"]) for r in got) == [("x.py", "py", "import os\n"), ("y.ts", "js", "let é = 1\n")]


WIDGETS = '''
from fast import router
from shop.stock import Shelf as Store, count as total
import shop.prices as prices

try:
    import extra
except ImportError:
    def fallback():
        return prices.tariff()
else:
    def preferred():
        return total()


class Service:
    def __init__(self, store: Store):
        self.store = store

    def place(self, item):
        return self.store.save(item)


class Controller:
    service: "Service"

    @router.post("/parcels")
    def create(self, item):
        log = Journal()
        log.write(item)
        return self.service.place(item)


def main(c: Controller | None):
    c.create(1)


main(None)
'''
STOCK = "class Base:\n    def save(self, item):\n        return item\n\nclass Shelf(Base):\n    pass\n\ndef count():\n    return 0\n"


def test_receivers_by_declared_type(spark):
    rows = [("app.py", "py", WIDGETS), ("shop/stock.py", "py", STOCK), ("shop/prices.py", "py", "def tariff():\n    return 1\n"), ("log.py", "py", "class Journal:\n    def write(self, x):\n        pass\n\n    def tariff(self):\n        pass\n")]
    f = spark.createDataFrame(rows, "path string, lang string, text string")
    n, c = P.nodes(f), P.calls(f)
    up = spark.createDataFrame([("Shelf", "Base")], "cls string, base string")
    got = {(r["source"], r["target"]) for r in P.resolve(c, n, up).collect()}
    assert got == {("Controller.create", "Service.place"), ("Service.place", "Base.save"), ("Controller.create", "Journal.write"), ("main", "Controller.create"), ("fallback", "tariff"), ("preferred", "count"), ("app.py", "main")}
    by = {r["id"]: r for r in n.collect()}
    assert (by["Controller.create"]["kind"], by["Controller.create"]["routes"]) == ("endpoint", ["POST /parcels"])
    assert by["main"]["entry"] == "module" and by["Service.__init__"]["entry"] == "init" and by["Service.place"]["signature"] == "place(self, item)"
    assert by["Service"]["attrs"] == ["store:Shelf"]


def test_measures_counted_by_hand(spark):
    text = "def rate(points, extra):\n    n = points\n    for e in extra:\n        if e > 0 and n < 50:\n            n += e\n    if n > 40:\n        return 1\n    elif n > 20:\n        return 2\n    return 3\n"
    (r,) = P.nodes(spark.createDataFrame([("a.py", "py", text)], "path string, lang string, text string")).collect()
    assert (r["complexity"], r["depth"], r["params"]) == (6, 2, 2)


def test_overloads_and_beans(spark):
    over = spark.createDataFrame([("draw(Shape)", "draw", ["Shape"]), ("draw(Shape,int)", "draw", ["Shape", "int"]), ("draw(Shape,str)", "draw", ["Shape", "str"])], "id string, name string, params array<string>")
    calls = spark.createDataFrame([(1, "run", "draw", ["Shape"]), (2, "run", "draw", ["Shape", "int"]), (3, "run", "draw", ["Shape", None]), (4, "go", "draw", [])], "site long, source string, name string, args array<string>")
    picked, open_ = dispatch.pick_overload(calls, over)
    assert {(r["site"], r["target"]) for r in picked.collect()} == {(1, "draw(Shape)"), (2, "draw(Shape,int)")}
    assert [tuple(r) for r in open_.collect()] == [("run", "draw")]
    beans = spark.createDataFrame([("a", "Sql", "Store", False, False), ("fast", "Quick", "Rule", False, False), ("slow", "Thorough", "Rule", False, False), ("x", "Wall", "Clock", False, False), ("y", "Fixed", "Clock", True, False), ("m", "Mem", "Cache", False, True), ("r", "Net", "Cache", False, False)], "bean string, cls string, type string, primary boolean, conditional boolean")
    asked = spark.createDataFrame([("one", "Store", None), ("two", "Rule", "slow"), ("three", "Rule", None), ("four", "Clock", None), ("five", "Cache", None), ("six", "Nothing", None)], "source string, type string, qualifier string")
    assert {(r["source"], r["target"]) for r in dispatch.spring_beans(asked, beans).collect()} == {("one", "Sql"), ("two", "Thorough"), ("three", "Rule"), ("four", "Fixed"), ("five", "Cache"), ("six", "Nothing")}


def test_search_takes_all_filters_together(spark):
    n = spark.createDataFrame([("Pay.charge", "service", "py"), ("Pay.refund", "service", "go"), ("pay_log", "util", "py")], "id string, layer string, lang string")
    e = spark.createDataFrame([("Pay.charge", "pay_log")], "source string, target string")
    ids = lambda **k: [r["id"] for r in find.search(n, e, **k).collect()]
    assert ids(name="pay", layer="service") == ["Pay.charge", "Pay.refund"]
    assert ids(name="pay", layer="service", calls="pay_log") == ["Pay.charge"] and ids(called_by="Pay.charge") == ["pay_log"]
    assert ids(orphans=True, lang="go") == ["Pay.refund"] and ids(limit=1) == ["Pay.charge"]


def test_churn_meets_files_by_unique_suffix(spark):
    churn = spark.createDataFrame([("src/app.py", 3), ("lib/util.py", 1), ("old/util.py", 2), ("deep/x.py", 4)], "path string, commits long")
    n = spark.createDataFrame([("f", "app.py"), ("g", "util.py"), ("h", "root/deep/x.py"), ("k", "p.py")], "id string, file string")
    assert {(r["id"], r["path"], r["commits"]) for r in review.churn_join(churn, n).collect()} == {("f", "src/app.py", 3), ("h", "deep/x.py", 4)}


def test_freshness_names_every_reason(spark):
    m = spark.createDataFrame([("a", "1")], "path string, sha string")
    g1, g2 = (spark.createDataFrame([("py", v)], "name string, version string") for v in ("1", "2"))
    r1, r2 = (spark.createDataFrame([(v,)], "root string") for v in ("src", "was"))
    assert tuple(review.freshness(m, m, g1, g1, r1, r1).first()) == (False, "")
    assert tuple(review.freshness(m, m, g1, g2, r1, r2).first()) == (True, "grammar drift,source root moved")
