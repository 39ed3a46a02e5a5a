"""Finders on small graphs: what must be found, and what must not."""

import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from weftline.operators import cycles, graph, paths


def nodes(spark, *rows):
    return spark.createDataFrame([(i, k, la, c) for i, k, la, c in rows], "id string, kind string, layer string, cls string")


def edges(spark, *rows):
    return spark.createDataFrame([(*r, "calls")[:3] for r in rows], "source string, target string, type string")


def plain(spark, names, layer="service"):
    return nodes(spark, *[(n, "function", layer, None) for n in names])


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_coupling_splits_hub_helper_coordinator(spark):
    pairs = [(f"c{i}", "helper") for i in range(40)] + [("coord", f"t{i}") for i in range(15)] + [(f"x{i}", "tangle") for i in range(6)] + [("tangle", f"y{i}") for i in range(6)]
    n = plain(spark, {a for p in pairs for a in p})
    c = graph.coupling(n, graph.app_edges(n, edges(spark, *pairs)))
    assert ids(graph.hubs(c)) == ["tangle"]
    assert ids(graph.shared_helpers(c)) == ["helper"]
    assert ids(graph.coordinators(c)) == ["coord"]


def test_hub_needs_callers_outside_tests(spark):
    pairs = [(f"a{i}", "h") for i in range(5)] + [("h", f"b{i}") for i in range(5)]
    names = {x for p in pairs for x in p}
    n = plain(spark, names)
    assert ids(graph.hubs(graph.coupling(n, graph.app_edges(n, edges(spark, *pairs))))) == ["h"]
    n = nodes(spark, *[(x, "function", "test" if x[0] == "a" else "service", None) for x in names])
    assert ids(graph.hubs(graph.coupling(n, graph.app_edges(n, edges(spark, *pairs))))) == []


def test_wrong_way_has_a_direction(spark):
    base = [(f"c{i}", "stable") for i in range(8)] + [("loose", f"t{i}") for i in range(8)]
    n = plain(spark, {x for p in base for x in p})
    for extra, found in ((("stable", "loose"), 1), (("loose", "stable"), 0)):
        a = graph.app_edges(n, edges(spark, *base, extra))
        assert graph.wrong_way(graph.coupling(n, a), a).count() == found


def test_layers(spark):
    n = nodes(spark, ("r", "m", "repository", None), ("c", "m", "controller", None), ("u", "m", "util", None))
    e = spark.createDataFrame([("r", "c", "calls"), ("r", "c", "http"), ("c", "u", "calls")], "source string, target string, type string")
    assert graph.layer_violations(n, graph.app_edges(n, e)).count() == 1
    assert graph.layer_violations(n, graph.app_edges(n, e.where("type = 'http'"))).count() == 0


def test_dead_nodes_and_exemptions(spark):
    n = nodes(spark, ("lone", "function", "service", None), ("t", "function", "test", None), ("impl", "method", "service", None), ("base", "method", "service", None), ("e", "endpoint", "service", None), ("K.__init__", "method", "service", None))
    e = spark.createDataFrame([("impl", "base", "implements")], "source string, target string, type string")
    assert ids(graph.dead_nodes(n, e)) == ["lone"]
    only = spark.createDataFrame([("impl", "base", "overrides")], "source string, target string, type string")
    assert ids(graph.dead_nodes(n, only)) == ["base", "lone"]


def test_god_objects_need_twelve(spark):
    n = nodes(spark, *[(f"m{i}", "method", "service", "Big") for i in range(12)], *[(f"s{i}", "method", "service", "Small") for i in range(11)], *[(f"t{i}", "method", "test", "Tests") for i in range(12)])
    assert [r["name"] for r in graph.god_objects(n, edges(spark, ("a", "b"))).collect()] == ["Big"]


def test_inheritance_is_walked_from_the_declaration(spark):
    e = spark.createDataFrame([("total", "price", "calls"), ("tiered", "price", "implements"), ("flat", "price", "implements")], "source string, target string, type string")
    adj = graph.adjacency(e)
    assert [r["id"] for r in paths.shortest_path(adj, "total", "tiered").orderBy("hop").collect()] == ["total", "price", "tiered"]
    assert "total" in ids(paths.impact_of(adj, spark.createDataFrame([("flat",)], "id string")))


def test_empty_graph(spark):
    n, e = plain(spark, ["a"]).limit(0), edges(spark, ("a", "b")).limit(0)
    a = graph.app_edges(n, e)
    assert graph.coupling(n, a).count() == cycles.find_cycles(a).count() == graph.dead_nodes(n, e).count() == 0
    assert paths.shortest_path(graph.adjacency(e), "a", "b").count() == 0


def brute_scc(links):
    out = {}
    verts = {v for p in links for v in p}
    reach = {v: {v} for v in verts}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            for v in verts:
                if a in reach[v] and b not in reach[v]:
                    reach[v].add(b)
                    changed = True
    for v in verts:
        out[v] = frozenset(w for w in verts if w in reach[v] and v in reach[w])
    return {s for s in out.values() if len(s) > 1}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), max_size=25))
def test_tarjan_is_mutual_reachability(links):
    links = [(f"n{a}", f"n{b}") for a, b in links if a != b]
    root = cycles.tarjan(links)
    groups = {r: frozenset(v for v in root if root[v] == r) for r in root.values()}
    assert {g for g in groups.values() if len(g) > 1} == brute_scc(links)


@pytest.mark.parametrize("links", [[("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "a")]])
def test_distributed_components_agree_with_the_task(spark, links):
    e = edges(spark, *links)
    one = {(r["id"], r["scc"]) for r in cycles.strong_components(e).collect()}
    many = {(r["id"], r["scc"]) for r in cycles.strong_components(e, last=0).collect()}
    assert one == many == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.sampled_from("abcde"), st.sampled_from("abcde")), min_size=1, max_size=10))
def test_shortest_path_is_the_least_of_the_shortest(spark, links):
    adj = spark.createDataFrame(sorted(links), "a string, b string")
    best = None
    for k in range(1, 6):
        found = [("a", *mid, "b") for mid in itertools.product("abcde", repeat=k - 1) if all(p in links for p in itertools.pairwise(("a", *mid, "b")))]
        if found:
            best = list(min(found))
            break
    got = [r["id"] for r in paths.shortest_path(adj, "a", "b").orderBy("hop").collect()]
    assert got == (best or [])
