import random

import pytest

from cairngraph.operators import hierarchy
from cairngraph.operators.hierarchy import node_hierarchies, node_paths
from tests.helpers import EDGES, edge, edges, rows


def brute(parents):
    out = {}
    for n in {*parents, *parents.values()}:
        x, k, seen = n, 0, set()
        while x in parents and x not in seen:
            seen.add(x)
            x, k = parents[x], k + 1
        out[n] = ("", -1) if x in parents else (x, k)
    return out


def below(parents, n, ends):
    return sum(1 for x in ends if x != n and n in ups(parents, x))


def ups(parents, x):
    out = set()
    while x in parents and x not in out:
        out.add(x)
        x = parents[x]
    return (out | {x}) - {None}


def check(spark, work, parents):
    e = edges(spark, [edge(f"{c}", p, c, "CONTAINS") for c, p in parents.items()])
    want = brute(parents)
    got = {r["node_id"]: r for r in node_hierarchies(e, work).collect()}
    assert {k: (r["root_id"], r["depth"]) for k, r in got.items()} == want
    for n, r in got.items():
        if r["depth"] >= 0:
            assert r["n_descendants"] == below(parents, n, want)
            inside = {m for m, o in got.items() if o["root_id"] == r["root_id"] and o["depth"] >= 0 and r["entry"] < o["entry"] < r["exit"]}
            assert inside == {x for x in want if x != n and n in ups(parents, x)}
        else:
            assert r["entry"] is None and r["n_descendants"] is None


def test_random_forest_with_cycles(spark, work):
    rng = random.Random(4)
    parents = {f"n{i}": f"n{rng.randint(0, i - 1)}" for i in range(1, 60) if rng.random() < 0.9}
    parents |= {"c1": "c2", "c2": "c3", "c3": "c1", "d1": "c1", "d2": "d1", "self": "self", "s2": "self"}
    check(spark, work, parents)


def test_long_chain_and_star(spark, work, monkeypatch):
    monkeypatch.setattr(hierarchy, "PEEL_SHARE", 0.6)
    check(spark, work, {f"x{i}": f"x{i + 1}" for i in range(40)} | {f"leaf{i}": "x0" for i in range(30)})


def test_a_hot_parent_is_split_off(spark, work, monkeypatch):
    from cairngraph.operators import skew

    monkeypatch.setattr(skew, "ROWS_PER_SALT", 7)
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(hierarchy, "ROWS_PER_SALT", 7)
    monkeypatch.setattr(hierarchy, "salted_prefix", lambda *a: skew.salted_prefix(*a, rows_per_salt=7))
    check(spark, work, {f"l{i}": "r" for i in range(30)} | {f"m{i}": "l3" for i in range(12)})


def test_names_whose_hashes_meet_get_other_numbers(spark, work):
    links = spark.createDataFrame([("h", "a", "b"), ("h", "c", "b"), ("g", "a", "c")], "hierarchy string, node string, parent string")
    numbers, names = hierarchy._numbered(links, work)
    met = names.where("name in ('a', 'b')")
    numbers, every = hierarchy._renumbered(links, names, work.save(met), work)
    got = {(r["hierarchy"], r["name"]): r["no"] for r in every.collect()}
    assert len(set(got.values())) == len(got) == 5
    assert sorted(map(tuple, numbers.collect())) == sorted([(got["h", "a"], got["h", "b"]), (got["h", "c"], got["h", "b"]), (got["g", "a"], got["g", "c"])])


def test_both_hierarchies_and_paths(spark, work):
    e = edges(spark, [edge("1", "pkg", "pkg.a ", "contains"), edge("2", "pkg.a", "pkg.a.f", "DECLARES"), edge("2", "pkg.a", "pkg.a.f", "DECLARES", at=4), edge("3", "Sub", "Base", "Extends"), edge("4", None, "x", "CONTAINS"), edge("5", "a", "b", "CALLS")])
    assert rows(node_hierarchies(e, work).select("hierarchy", "node_id", "root_id", "depth")) == [("containment", "pkg", "pkg", 0), ("containment", "pkg.a", "pkg", 1), ("containment", "pkg.a.f", "pkg", 2), ("inheritance", "Base", "Base", 0), ("inheritance", "Sub", "Base", 1)]
    assert ("containment", "pkg.a.f", "pkg/pkg.a/pkg.a.f") in rows(node_paths(e, work))


@pytest.mark.parametrize("rows_", [[], [edge("1", "a", "b", "CALLS")]])
def test_no_links(spark, work, rows_):
    e = edges(spark, rows_) if rows_ else spark.createDataFrame([], EDGES)
    assert node_hierarchies(e, work).count() == 0
    assert node_paths(e, work).count() == 0
