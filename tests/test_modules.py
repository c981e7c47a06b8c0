import itertools
import random

import pytest

from cairngraph.operators import structure
from tests.helpers import edge, graph, node, rows


def reach(links, start):
    seen, todo = set(), [start]
    while todo:
        for a, b in links:
            if a == todo[0] and b not in seen:
                seen.add(b)
                todo.append(b)
        todo.pop(0)
    return seen


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_reduction_against_brute_force(spark, work, one_task):
    rng = random.Random(9)
    links = {(f"n{a}", f"n{b}") for a, b in itertools.combinations(range(14), 2) if rng.random() < 0.35}
    want = sorted((a, b) for a, b in links if any(b in reach(links, c) for x, c in links if x == a and c != b))
    assert rows(structure.implied_links(spark.createDataFrame(sorted(links), "src string, dst string"), work, one_task)) == want and want
    edges = spark.createDataFrame([(a, b, k) for k in ("imports", "extends") for a, b in sorted(links)] + [("n3", "n0", "imports"), ("x", "y", "calls")], "source string, target string, kind string")
    kept = structure.reduced_layers(edges, work, one_task)
    assert rows(kept.where("kind = 'extends'").select("source", "target")) == sorted(links - set(want))
    assert rows(kept.where("kind = 'calls'")) == [("x", "y", "calls")]
    cycle = reach(links, "n0") & {x for x, _ in links if "n3" in reach(links, x)} | {"n0", "n3"}
    assert all((a, b, "imports") in rows(kept) for a, b in links if a in cycle and b in cycle)


def module(i, **k):
    return node(i, "FILE", file_path=i.replace(".", "/") + ".py", **k)


def test_module_graph(spark, work):
    n = [module(i) for i in ("p", "p.a", "p.b", "p.c", "p.s", "p.s.x", "p.s.y", "o.u", "o", "r.z")] + [module("p.t", test=True)]
    n += [node(f"{f}.f", file_path=f.replace(".", "/") + ".py") for f in ("p.a", "p.b", "p.c", "p.s.x")]
    e = [edge("1", "p.a", "p.b", "IMPORTS"), edge("2", "p.b", "p.c", "IMPORTS"), edge("3", "p.a", "p.c", "IMPORTS"), edge("4", "p.a.f", "p.b.f", "EXTENDS"), edge("5", "p.s.x", "p.s.y", "IMPORTS"), edge("6", "p.s.x.f", "p.a", "IMPORTS"), edge("7", "p.t", "p.a", "IMPORTS"), edge("8", "p.c", "p.a", "IMPORTS", type_only=True), edge("9", "p.a", "o.u.g", "IMPORTS"), edge("10", "p.b", "o.u", "IMPORTS"), edge("11", "p.c", "r.z", "IMPORTS"), edge("12", "p.c", "p", "IMPORTS"), edge("13", "p.a", "p.s", "IMPORTS"), edge("14", "p.a", "p.s.y", "IMPORTS_SYMBOL")]
    g = graph(spark, work, n, e)
    got = structure.module_graph(g, "p")
    # a on s and s on a is a cycle of imports; b follows inheritance; a to c is implied.
    assert rows(got.edges) == [("p.a", "p.b", "extends"), ("p.a", "p.s", "imports"), ("p.b", "p.c", "imports"), ("p.s", "p.a", "imports")]
    assert rows(got.counts) == [("extends", 0, 0), ("imports", 1, 1)]
    assert rows(got.outside) == [("p.b", "o"), ("p.c", "r")]
    wide = structure.module_graph(g, "p", expand=True)
    assert rows(wide.edges.where("source = 'p.a' and kind = 'imports'")) == [("p.a", "p.s.y", "imports")]
    plain = structure.module_graph(g, "p", layers=("imports",), reduce=False, exclude_tests=False)
    assert ("p.a", "p.c", "imports") in rows(plain.edges) and ("p.t", "p.a", "imports") in rows(plain.edges) and ("p.a", "p.b", "imports") in rows(plain.edges)
    with pytest.raises(ValueError):
        structure.module_graph(g, "p", layers=("none",))


def test_suggestions(spark, work):
    n = [module(i) for i in ("p", "p.a1", "p.a2", "p.a3", "p.b1", "p.b2", "p.b3", "lone", "flat.x", "flat.y", "s.t.a", "s.t.b", "s.u")]
    pairs = [(f"p.{c}{i}", f"p.{c}{j}") for c in "ab" for i, j in itertools.combinations((1, 2, 3), 2)] + [("p.a1", "p.b1"), ("s.t.a", "s.t.b"), ("flat.x", "nowhere.z")]
    g = graph(spark, work, n, [edge(f"e{k}", a, b, "IMPORTS") for k, (a, b) in enumerate(pairs)])
    s = structure.suggest_packages(g, " p ")
    v = s.verdict.first()
    assert (v["n_files"], v["n_edges"], v["verdict"], v["direction"], v["note"]) == (7, 7, "split", "under_split", None) and v["modularity"] > 0.35
    groups = {}
    for r in s.members.collect():
        groups.setdefault(r["community"], set()).add(r["id"])
    assert sorted(map(sorted, groups.values())) == [["p"], ["p.a1", "p.a2", "p.a3"], ["p.b1", "p.b2", "p.b3"]]
    assert rows(s.bridges) == [("p.a1", "p.b1", 1.0)]
    note = lambda prefix, **k: structure.suggest_packages(g, prefix, **k).verdict.first()["note"]
    assert [note(x) for x in ("", "none", "lone", "s.t", "s", "flat")] == ["no prefix", "no files", "a single module", None, "links stay inside sub-packages", "no import resolves inside"]
