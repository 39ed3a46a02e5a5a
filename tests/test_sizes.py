"""What queries send between tasks, and results that a smaller job would miss."""

import pytest

import __spark_entry__ as entry
from weftline.functions import text as X
from weftline.operators import clones, review, sequences

SF = "/root/testdata/sf0.01"


def shuffled(spark, name):
    """MB that a query writes for shuffles, none of its joins by broadcast."""
    sc = spark.sparkContext._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty(30_000)
        e = sc.statusStore().executorList(True)
        return sum(e.apply(k).totalShuffleWrite() for k in range(e.size())) / 1e6

    key = "spark.sql.autoBroadcastJoinThreshold"
    was, before = spark.conf.get(key), total()
    spark.conf.set(key, "-1")
    try:
        entry.queries()[name](spark, SF).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set(key, was)
    return total() - before


@pytest.mark.parametrize("name, most", [("clone_blocks", 8), ("report", 9), ("graded_first", 5)])
def test_little_is_sent(spark, name, most):
    sent = shuffled(spark, name)
    assert sent < most


def test_sequences_are_the_tokens_of_files_and_of_repeated_paths(spark):
    line = "If x1 > 2 and y == 'a' or Not None: # c\n\nreturn é + x // 2 * /* z */ 3.5\n"
    rows = [("a.py", "py", line * 3), ("b.js", "js", line * 3), ("two.py", "py", line * 2), ("two.py", "py", line * 2), (None, "py", line * 2), (None, "py", line * 2), ("few.py", "py", "x = 1"), ("none.py", "py", None)]
    f = spark.createDataFrame(rows, "path string, lang string, text string")
    want = {tuple(r) for r in clones.bodies(clones.tokens(X.lines(f))).collect()}
    assert {tuple(r) for r in sequences.bodies(f).collect()} == want and len(want) == 4


def _tests(spark):
    nodes = spark.createDataFrame([("a", "run", None), ("a", "run", None), ("a", "go", "the"), ("b", "run", "the"), ("c", "no", None), ("c", "no", None), ("d", None, None)], "id string, name string, cls string")
    seen = spark.createDataFrame([("t1", "run"), ("t1", "go"), ("t1", "the"), ("t2", "run"), ("t2", "go")], "path string, ident string")
    return nodes, seen


def test_a_repeated_id_meets_a_test_once(spark):
    assert sorted(map(tuple, review.tests_join(*_tests(spark)).collect())) == [("a", "t1"), ("a", "t2"), ("b", "t1")]


def test_more_tests_and_nodes_than_go_together(spark, monkeypatch):
    monkeypatch.setattr(review, "PATHS", 3)
    monkeypatch.setattr(review, "NODES", 4)
    nodes = spark.range(30).selectExpr("concat('n', id) as id", "if(id % 3 = 0, 'go', 'run') as name", "cast(null as string) as cls")
    seen = spark.range(20).selectExpr("concat('t', id) as path", "if(id % 2 = 0, 'go', 'run') as ident")
    assert review.tests_join(nodes, seen).distinct().count() == review.tests_join(nodes, seen).count() == 30 * 10


def test_tested_without_pairs(spark):
    assert {tuple(r) for r in review.tested(*_tests(spark)).collect()} == {("a", 3, True), ("b", 1, True), ("c", 2, False), ("d", 1, False)}
