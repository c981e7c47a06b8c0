import json

from cairngraph.operators import keys, storage, traversal
from cairngraph.plans import graph_queries
from tests.helpers import edge, graph, node, rows


def test_rows_the_test_data_lacks(spark, work):
    n = [node("p.a", "FILE", metadata='{"build_excluded": "windows"}', file_path="p/a.go"), node("p.b", "FILE"), node("A", "CLASS"), node("A.run", "METHOD"), node("B", "CLASS"), node("B.run", "METHOD"), node("C", "CLASS"), node("C.run", "METHOD"), node("C.stop", "METHOD")]
    e = [edge("1", "A.run", "key:s|a.b", "READS_KEY", file_path="x.py"), edge("2", "B.run", "key:|a.b", "WRITES_KEY", file_path="y.py"), edge("3", "B.run", "key:t|a.b", "READS_KEY"), edge("4", "B.run", "key:s|a", "DECLARES_KEY"), edge("5", "B.run", "key:t|a.b.c", "READS_KEY"), edge("6", "B", "A", "EXTENDS"), edge("7", "C", "B", "EXTENDS")]
    g = graph(spark, work, n, e)
    assert rows(storage.build_excluded_files(g)) == [("p/a.go", "windows")]
    sites = keys.key_sites(g)
    assert rows(keys.key_matches(sites)) == [("key:s|a.b", "key:|a.b"), ("key:t|a.b", "key:|a.b")]
    assert rows(keys.keys_inside(sites)) == [("key:s|a", "key:s|a.b"), ("key:t|a.b", "key:t|a.b.c")]
    assert rows(graph_queries.dispatch_edges(g)) == [("A.run", "B.run"), ("B.run", "C.run")]


def test_a_budget_cuts_one_level_in_order(spark, work):
    n = [node("hub"), *[node(f"c{i}") for i in range(4)], node("f", "FILE"), node("x", namespace="EXTERNAL", file_path="EXTERNAL"), node("t", test=True), node("far")]
    e = [edge(f"e{i}", s, "hub") for i, s in enumerate(["c0", "c1", "c2", "c3", "f", "x", "t"])] + [edge("up", "far", "c0"), edge("up2", "far", "f")]
    g = graph(spark, work, n, e)
    cut = traversal.walk(g, ["hub"], True, 3, budget=4)
    assert rows(cut.reached) == [("c0", 1), ("c1", 1), ("c2", 1), ("hub", 0)] and (cut.omitted, cut.cut_at) == (4, 1)
    screened = traversal.walk(g, ["hub"], True, 3, hide_tests=True, internal_only=True, budget=200)
    assert rows(screened.reached) == [("c0", 1), ("c1", 1), ("c2", 1), ("c3", 1), ("f", 1), ("far", 2), ("hub", 0)] and screened.omitted == 0
    assert ("hub", 1) in rows(traversal.walk(g, ["t"], False, 1, hide_tests=True).reached)
    # A test among the roots: tests are shown; a file among them: files are walked through.
    g2 = graph(spark, work, [node("t1", test=True), node("t2", test=True), node("f1", "FILE"), node("f2", "FILE"), node("z")], [edge("1", "t2", "t1"), edge("2", "f2", "f1", "IMPORTS"), edge("3", "z", "f2", "IMPORTS")])
    assert rows(traversal.walk(g2, ["t1"], True, 2, hide_tests=True).reached) == [("t1", 0), ("t2", 1)]
    assert rows(traversal.walk(g2, ["f1"], True, 3, budget=9).reached) == [("f1", 0), ("f2", 1), ("z", 2)]


def test_json(spark, work):
    g = graph(spark, work, [node("a"), node("b")], [edge("1", "a", "b", confidence=0.5), edge("2", "a", "b", confidence=0.9), edge("3", "b", "a", "IMPORTS")])
    got = {(r["kind"], r["id"]): json.loads(r["body"]) for r in graph_queries.graph_json(g).collect()}
    assert set(got) == {("node", "a"), ("node", "b"), ("edge", "a CALLS b"), ("edge", "b IMPORTS a")}
    assert got["edge", "a CALLS b"]["confidence"] == 0.9 and got["node", "a"]["start_line"] == 1
