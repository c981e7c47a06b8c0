import itertools
import random

import pytest
from pyspark.sql import functions as F

from cairngraph.operators import drift, evaluation, keys, metrics, motifs, resolution, storage, structure, traversal
from cairngraph.operators.components import connected_components, strong_components
from tests.helpers import edge, graph, node, rows


def chain(n, type="CALLS"):
    return [node(f"p.f{i}") for i in range(n)], [edge(f"e{i}", f"p.f{i}", f"p.f{i + 1}", type) for i in range(n - 1)]


def reach(links, a):
    seen, todo = set(), [a]
    while todo:
        for x, y in links:
            if x == todo[-1] and y not in seen:
                seen.add(y)
                todo.insert(0, y)
        todo.pop()
    return seen


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components_against_brute_force(spark, work, one_task):
    rng = random.Random(6)
    links = [(f"n{rng.randint(0, 14):02}", f"n{rng.randint(0, 14):02}") for _ in range(20)]
    to = {a: reach(links, a) for a in {x for p in links for x in p}}
    want = {}
    for a in to:
        group = {b for b in to[a] if a in to[b]} | {a}
        if len(group) > 1:
            want[a] = (min(group), len(group))
    got = strong_components(spark.createDataFrame(links, "src string, dst string"), work, one_task)
    assert {r["id"]: (r["component"], r["size"]) for r in got.collect()} == want
    both = links + [(b, a) for a, b in links]
    whole = {a: min(reach(both, a) | {a}) for a in to}
    got = connected_components(spark.createDataFrame(links, "a string, b string"), work, one_task)
    assert {r["id"]: r["component"] for r in got.collect()} == whole


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components_of_nothing(spark, work, one_task):
    assert strong_components(spark.createDataFrame([], "src string, dst string"), work, one_task).count() == 0
    assert connected_components(spark.createDataFrame([], "a string, b string"), work, one_task).count() == 0


def test_triads_by_hand(spark, work):
    one = {"021D": "ba bc", "021U": "ab cb", "021C": "ab bc", "111D": "ac ca bc", "111U": "ac ca cb", "030T": "ab bc ac", "030C": "ab bc ca", "201": "ab ba bc cb", "120D": "ba bc ac ca", "120U": "ab cb ac ca", "120C": "ab bc ac ca", "210": "ab bc cb ac ca", "300": "ab ba bc cb ac ca"}
    links = [(t, p[0], p[1]) for t, ps in one.items() for p in ps.split()] + [("300", "a", "a"), ("300", "a", "b")]
    got = motifs.triad_census(spark.createDataFrame(links, "domain string, src string, dst string"))
    assert {(r["domain"], r["triad"]) for r in got.where("n > 0").collect()} == {(t, t) for t in one}
    assert got.count() == 13 * 13 and got.agg(F.sum("n")).first()[0] == 13


def test_triads_against_brute_force(spark, work):
    rng = random.Random(7)
    ids = [f"n{i}" for i in range(12)]
    links = {tuple(rng.sample(ids, 2)) for _ in range(45)}
    want = dict.fromkeys(motifs.TRIADS, 0)
    for v, u, w in itertools.combinations(ids, 3):
        name = motifs.triad_name(sum(1 << k for k, p in enumerate([(v, u), (u, v), (v, w), (w, v), (u, w), (w, u)]) if p in links))
        if name:
            want[name] += 1
    got = motifs.triad_census(spark.createDataFrame([("d", *x) for x in links], "domain string, src string, dst string"))
    assert {r["triad"]: r["n"] for r in got.collect()} == want


def test_walk_depth_dispatch_and_budget(spark, work):
    n, e = chain(5)
    g = graph(spark, work, [*n, node("p.o"), node("p.t", test=True)], [*e, edge("d", "p.f2", "p.o", "DISPATCHES"), edge("t", "p.t", "p.f4")])
    assert dict(rows(traversal.walk(g, ["p.f0"], False, 2).reached)) == {"p.f0": 0, "p.f1": 1, "p.f2": 2, "p.o": 2}
    up = traversal.walk(g, ["p.f4"], True, 1, hide_tests=True)
    assert dict(rows(up.reached)) == {"p.f4": 0, "p.f3": 1} and rows(up.edges) == [("e3",)]
    cut = traversal.walk(g, ["p.f4"], True, 3, budget=2)
    assert (cut.omitted, cut.cut_at) == (1, 1) and cut.reached.count() == 2
    assert traversal.walk(g, ["nowhere"], True, 3).reached.count() == 1


@pytest.mark.parametrize("twice", [False, True])
def test_depths_and_labels_with_one_way_up_and_several(spark, work, twice):
    n = [node("f", "FILE", domains=["x"]), node("c", "CLASS"), node("m", "METHOD"), node("k", "METHOD"), node("l", "METHOD")]
    e = [edge("1", "f", "c", "CONTAINS"), edge("2", "c", "m", "DECLARES"), edge("3", "k", "l", "CONTAINS"), edge("4", "l", "k", "CONTAINS")] + [edge("5", "f", "m", "CONTAINS")] * twice
    g = graph(spark, work, n, e)
    assert dict(rows(metrics.structural_depth(g))) == {"f": 0, "c": 1, "m": 1 if twice else 2, "k": 0, "l": 0}
    labels = g.nodes.where("type = 'FILE'").select("id", F.explode("domains").alias("label"))
    assert rows(traversal.propagate_labels(g, labels)) == [("c", "x"), ("f", "x"), ("m", "x")]
    assert {r["id"] for r in metrics.health(g).where("in_cycle").collect()} == set()


def test_lcom4(spark, work):
    m = lambda i, attrs, **k: node(f"c.{i}", "METHOD", metadata='{"self_attrs": %s}' % str(attrs).replace("'", '"'), **k)
    n = [node("c", "CLASS"), m("a", ["x"]), m("b", ["x"]), m("d", ["y"]), m("e", []), m("__init__", ["x", "y"]), node("s", "CLASS"), node("s.q", "METHOD")]
    e = [edge(f"d{i}", "c", f"c.{i}", "DECLARES") for i in ("a", "b", "d", "e", "__init__")] + [edge("k", "c.d", "c.e"), edge("s", "s", "s.q", "DECLARES")]
    assert rows(metrics.class_cohesion(graph(spark, work, n, e))) == [("c", 4, 2)]


def test_degrees_cycles_and_orphans(spark, work):
    n = [node("h"), *[node(f"c{i}") for i in range(5)], node("x", "FILE", file_path="x.py"), node("y", "FILE", file_path="y.py"), node("z", "FILE", file_path="z.py"), node("x.K", "CLASS", file_path="x.py"), node("x.U", "CLASS", file_path="x.py")]
    e = [edge(f"{i}", f"c{i}", "h") for i in range(5)] + [edge("p", "c0", "h"), edge("r", "c1", "raw_call:print"), edge("i1", "x", "y", "IMPORTS"), edge("i2", "y", "x", "IMPORTS"), edge("i3", "y", "z", "IMPORTS"), edge("i4", "z", "y", "IMPORTS", type_only=True), edge("u", "c1", "x.U", "REFERENCES")]
    g = graph(spark, work, n, e)
    got = {r["id"]: (r["in_degree"], r["out_degree"]) for r in metrics.node_coupling(g).collect()}
    assert got["h"] == (6, 0) and got["c0"] == (0, 2) and got["c1"] == (0, 1)
    assert rows(metrics.import_cycles(g)) == [("x", "x", 2), ("y", "x", 2)]
    assert rows(metrics.orphan_classes(g)) == [("x.K",)]
    assert {r["id"]: r["instability"] for r in metrics.file_coupling(g).collect()}["x"] == 0.5
    s = storage.edge_stats(g).first()
    assert (s["total"], s["unresolved"]) == (12, 1)
    assert abs(metrics.pagerank(g).agg(F.sum("rank")).first()[0] - 1) < 1e-9


def test_reduction_keeps_cycles(spark, work):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "c"), ("a", "d")], "source string, target string")
    assert rows(structure.transitive_reduction(e, work)) == [("a", "b"), ("b", "c"), ("c", "d"), ("d", "c")]


def test_communities_of_two_cliques(spark, work):
    ids = "abcdef"
    pairs = [(x, y) for g in ("abc", "def") for x in g for y in g if x != y] + [("c", "d"), ("d", "c")]
    graphs = spark.createDataFrame([("p", x, y, 1.0) for x, y in pairs], "package string, a string, b string, weight double")
    got = structure.communities(graphs, spark.createDataFrame([("p", i) for i in [*ids, "alone"]], "package string, id string"))
    assert {r["id"]: r["community"] for r in got.collect()} == {**dict.fromkeys("abc", "a"), **dict.fromkeys("def", "d"), "alone": "alone"}
    assert abs(got.first()["modularity"] - (12 / 14 - 0.5)) < 1e-9


def test_drift_scores_and_gate(spark):
    rows_ = spark.createDataFrame([("a", 0.0, 0.5, 4.0), ("b", 0.3, 0.0, 1.0)], "domain string, cycle_ratio double, unresolved_ratio double, hub_count double")
    bounds = drift.constraints({"hub_count": {"min": "$hubs"}, "cycle_ratio": {"max": 0.0}}, {"hubs": 8})
    got = {r["domain"]: r["drift"] for r in drift.constraint_drift(rows_, bounds, {"hub_count": 1.0, "cycle_ratio": 1.0}).collect()}
    assert abs(got["a"] - 0.5 * 0.5 / 1.5) < 1e-12 and abs(got["b"] - (7 / 8 + 0.3) / 2) < 1e-12
    gate = drift.hygiene_gate(rows_, {k: drift.HYGIENE[k] for k in ("cycle_ratio", "unresolved_ratio")})
    assert {r["domain"]: r["breaches"] for r in gate.collect()} == {"a": "unresolved_ratio", "b": "cycle_ratio"}
    assert not drift.hygiene_gate(rows_, {"cycle_ratio": ("max", 0.0)}, {"cycle_ratio": 0.5}).where("failed").count()


def test_fit_of_a_star(spark, work):
    star = spark.createDataFrame([("d", f"c{i}", "hub") for i in range(5)], "domain string, src string, dst string")
    shares = motifs.normalized(motifs.triad_census(star))
    fit = drift.template_fit(shares, shares, spark.createDataFrame([("d", 0.0)], "domain string, unresolved_ratio double"))
    best = fit.where("rank = 1").first()
    assert (best["template"], best["residual"], best["fit"]) == ("pure_utility", 0.0, "good")


def test_spans_and_hunks(spark):
    n = spark.createDataFrame([("a", "f.py", 1, 200), ("b", "f.py", 63, 64), ("c", "g.py", 1, 9)], "id string, file_path string, start_line int, end_line int")
    lines = spark.createDataFrame([("./f.py", 64), ("f.py", 150), ("f.py", 201)], "file_path string, line int")
    assert rows(keys.span_join(n, lines)) == [("a", "f.py", 150), ("a", "f.py", 64), ("b", "f.py", 64)]
    diff = "--- a/f.py\n+++ b/f.py\n@@ -1,2 +3,4 @@ x\n@@ -9 +10,0 @@\n--- a/g\n+++ /dev/null\n@@ -1 +0,0 @@\n"
    assert keys.hunks(diff) == [("f.py", 3, 6), ("f.py", 10, 10)]


def test_statistics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (2.0, 3.0), (4.0, 9.0)], "x double, y double")
    assert abs(evaluation.spearman(df, "x", "y").first()["rho"] - 0.9486832980505138) < 1e-9
    assert evaluation.spearman(df.limit(2), "x", "y").first()["rho"] is None
    flags = spark.createDataFrame([(True, True), (False, False), (True, False), (None, True)], "a boolean, b boolean")
    r = evaluation.agreement(flags, "a", "b").first()
    assert r["n"] == 3 and abs(r["kappa"] - 0.4) < 1e-9 and r["positive_agreement"] == 0.5
    assert evaluation.paired_effect(spark.createDataFrame([(2.0,), (2.0,)], "d double"), "d").first()["passes"]
    pairs = spark.createDataFrame([("r", "a", "1", 0.9), ("r", "a", "2", 0.8), ("r", "b", "1", 0.7)], "k string, l string, r string, s double")
    assert rows(evaluation.max_matching(pairs, "k", "l", "r")) == [("r", 2)]
    assert rows(evaluation.greedy_matching(pairs, "k", "l", "r", "s")) == [("r", "a", "1")]


def test_dispatch_interfaces_and_order(spark, work):
    n = [node("A", "CLASS"), node("B", "CLASS"), node("C", "CLASS"), node("A.run", "METHOD"), node("C.run", "METHOD"), node("C.__str__", "METHOD")]
    g = graph(spark, work, n, [edge("1", "B", "A", "EXTENDS"), edge("2", "C", "B", "EXTENDS"), edge("3", "A", "C", "EXTENDS")])
    assert rows(resolution.hierarchy_dispatch(g)) == [("A.run", "C.run"), ("C.run", "A.run")]
    needs = spark.createDataFrame([("I", "a", 1), ("I", "b", None)], "interface string, method string, arity int")
    has = spark.createDataFrame([("T", "a", 1), ("T", "b", 3), ("U", "a", 2), ("U", "b", 1)], "type string, method string, arity int")
    assert rows(resolution.interface_dispatch(needs, has)) == [("I", "T")]
    hops = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "symbol string, to string")
    assert dict(rows(resolution.reexports(hops, work))) == {"a": "d", "b": "d", "c": "d"}


def _c3(tree):
    """Python's own answer: the order of a class, None where Python refuses it."""
    made, out = {}, {}
    for c, bases in tree.items():
        try:
            made[c] = type(c, tuple(made[b] for b in bases) or (object,), {}) if all(b in made for b in bases) else None
        except TypeError:
            made[c] = None
        if made[c] is None:
            del made[c]
        else:
            out[c] = [x.__name__ for x in made[c].__mro__[:-1]]
    return out


def test_method_order_is_pythons(spark, work):
    rng = random.Random(12)
    tree = {"Z": [], "A": [], "M": ["Z", "A"], "N": ["A", "Z"], "bad": ["M", "N"], "worse": ["bad"]}
    for i in range(40):
        tree[f"c{i}"] = rng.sample([x for x in tree if x not in ("bad", "worse")], rng.randint(1, 3))
    want = {c: o for c, o in _c3(tree).items() if tree[c]}
    links = [(c, b, k) for c, bases in tree.items() for k, b in enumerate(bases)] + [("x", "y", 0), ("y", "x", 0), ("on", "x", 0)]
    got = {}
    for r in resolution.method_order(spark.createDataFrame(links, "class string, base string, position int"), work).orderBy("class", "nth").collect():
        got.setdefault(r["class"], []).append(r["member"])
    assert got == want and got["M"] == ["M", "Z", "A"] and "worse" not in got
    deep = spark.range(30).selectExpr("concat('d', id) as class", "concat('d', id + 1) as base", "0 as position")
    assert resolution.method_order(deep, work).where("class = 'd0'").count() == 31


def test_merges(spark, work):
    n = [node("a", at=1), node("a", at=5, gone=6), node("b", at=2, gone=3), node("b", at=4, lines=(5, 6))]
    g = graph(spark, work, n, [])
    assert rows(g.nodes.select("id", "start_line")) == [("b", 5)]
    v = [node("v", file_path="EXTERNAL", namespace="UNKNOWN", at=9), node("v", file_path="EXTERNAL", namespace="STDLIB", at=1)]
    from tests.helpers import nodes

    assert storage.ranked_virtual_upsert(nodes(spark, v)).first()["namespace"] == "STDLIB"


def test_search(spark, work):
    g = graph(spark, work, [node("p.fold"), node("p.x.folding"), node("p.unfold"), node("p.FOLD")], [])
    assert [r["id"] for r in storage.symbol_search(g, "fold").collect()] == ["p.fold", "p.FOLD", "p.x.folding", "p.unfold"]
    assert storage.symbol_search(g, " ").count() == 0
    assert [r["id"] for r in storage.symbol_search(g, "fold", prefix="p.x").collect()] == ["p.x.folding"]
