import pytest

from cairngraph.operators import drift, drift_run as dr
from tests.helpers import edge, graph, node, rows


def star(p, n=5, kind="CALLS"):
    """n functions that call one: 021U alone."""
    return [node(f"{p}.f{i}") for i in range(n)] + [node(f"{p}.hub")], [edge(f"{p}{kind}{i}", f"{p}.f{i}", f"{p}.hub", kind) for i in range(n)]


def test_baselines():
    assert drift.relaxed_bounds({"a": ("max", 0.2), "b": ("min", 3), "c": ("exact", 0.2)}, {"a": 0.5, "b": 5, "c": 0.5}) == {"a": ("max", 0.5), "b": ("min", 3), "c": ("exact", 0.5)}
    assert drift.relaxed_bounds({"a": ("max", 0.2)}, {"a": 0.1}) == {"a": ("max", 0.2)}


def test_scores_and_gates(spark, work):
    n1, e1 = star("u")
    n2, e2 = star("tangle", 1)
    e2 += [edge("back", "tangle.hub", "tangle.f0"), edge("more", "tangle.f0", "tangle.x"), edge("again", "tangle.x", "tangle.f0"), edge("raw", "tangle.f0", "raw_call:y")]
    g = graph(spark, work, [*n1, *n2, node("tangle.x"), node("idle.a"), node("idle.b"), node("loose.z")], [*e1, *e2])
    catalog = dr.Catalog(
        domains=(dr.Binding("good", "u", "pure_utility", 0.3, "python"), dr.Binding("bad", "u", "orchestrator", 0.3, "python"), dr.Binding("t", "tangle", "funnel", 0.9, "python"), dr.Binding("t2", "tangle", None, 0.9, None, {}, {"tangle_ratio": 1.0, "unresolved_ratio": 0.5}), dr.Binding("i", "idle"), dr.Binding("e", "gone", enforce=False)),
        levels=(dr.Binding("q", "quotient", None, 0.5, None),),
    )
    run = dr.drift_run(g, catalog)
    got = {r["name"]: r for r in run.reports.collect()}
    assert {k: r["status"] for k, r in got.items()} == {"good": "clean", "bad": "critical", "t": "gate_failed", "t2": "clean", "i": "no_signal", "e": "empty", "q": "no_signal"}
    assert got["good"]["score"] == 0.0 and got["good"]["nearest"] == "pure_utility" and got["good"]["band"] == "good" and got["good"]["tv_imports"] is None
    # The shape is all off on calls (0.35), the bounds are kept (0.30).
    assert abs(got["bad"]["score"] - 0.35 / 0.65) < 1e-9
    assert got["t"]["breaches"] == "tangle_ratio"
    assert got["t2"]["acknowledged"] == "tangle_ratio,unresolved_ratio" and got["t2"]["breaches"] == ""
    assert rows(run.coverage) == [("loose",)] and run.failed.first()[0]
    alone = dr.drift_run(g, dr.Catalog(domains=catalog.domains[:1]))
    assert not alone.failed.first()[0]
    assert dr.drift_run(g, catalog, profile="typescript").reports.where("level = 'package'").count() == 3


def test_nested_packages_and_forwarded_names(spark, work):
    m = [node(f"p.{x}", "FILE", metadata='{"reexports": {"X": "p.c.X"}}' if x == "b" else "{}") for x in "abc"] + [node("p.s.k"), node("p.s.l")]
    g = graph(spark, work, m, [edge("1", "p.a", "p.b", "IMPORTS"), edge("2", "p.b", "p.c", "IMPORTS"), edge("3", "p.a", "p.b.X", "IMPORTS_SYMBOL"), edge("4", "p.s.k", "p.s.l")])
    prints = {r["domain"]: r for r in dr.fingerprints(g.nodes, g.edges, dr.members_of(g.nodes, ["p", "p.s", "none"]), work).collect()}
    assert set(prints) == {"p", "p.s"} and prints["p"]["node_count"] == 5 and prints["p.s"]["edge_count"] == 1
    assert prints["p"]["t_imports"]["030T"] == 1.0 and prints["p"]["dag_depth"] == 2 and prints["p.s"]["chain_len"] == 1.0


def test_catalogs():
    c = dr.Catalog.of('{"patterns": {"p": {"ideal": {"imports": {"021U": 1}, "calls": {"021C": 1}}, "params": {"d": 2}, "dag_depth": {"min": "$d"}}}, "profiles": {"py": {"drift_weights": {"dag_depth": 1}, "layers": {"imports": 0.5, "calls": 0.2, "gates": 0.3}}}, "hygiene": {"cycle_ratio": {"max": 0}}, "project_domains": [{"name": "a", "fqn_prefix": "a", "expected_pattern": "p", "profile": "py", "params": {"d": 4}}], "project_level": [{"name": "q", "fqn_prefix": "quotient"}]}')
    assert c.scored_bounds(c.domains[0]) == {"cycle_ratio": ("max", 0.0), "dag_depth": ("min", 4.0)} and c.levels[0].enforce is False
    for bad in (dr.Binding("x", "x", baseline={"none": 1.0}), dr.Binding("x", "x", profile="none"), dr.Binding("x", "x", "layered_dag", params={"other": 1.0})):
        with pytest.raises(ValueError):
            dr.Catalog(domains=(bad,))


def test_proposals_pass(spark, work):
    n, e = star("u", 12)
    m, f = star("few", 3)
    g = graph(spark, work, [*n, *m], [*e, *f])
    got = {r["prefix"]: r for r in dr.propose(g, spark.createDataFrame([("u",), ("few",)], "prefix string"), dr.Catalog()).collect()}
    assert got["u"]["pattern"] == "pure_utility" and got["u"]["tolerance"] == 0.03 and got["few"]["reason"] == "too small" and got["few"]["pattern"] is None
    bound = dr.Catalog(domains=tuple(dr.Binding(p, p, r["pattern"], r["tolerance"], "python", {}, r["baseline"]) for p, r in got.items()))
    assert not dr.drift_run(g, bound).failed.first()[0]
