from cairngraph.operators import motifs
from tests.helpers import edge, graph, node, rows


def test_longest_calls_and_imports_with_a_cycle(spark, work):
    n = [node(f"p.{x}") for x in "abcdes"] + [node(f"p.m{k}", "MODULE") for k in range(3)] + [node("q.f")]
    # In at b and on from c of the cycle b, c; s calls itself, so it is no root.
    calls = [("p.a", "p.b"), ("p.b", "p.c"), ("p.c", "p.b"), ("p.c", "p.d"), ("p.d", "p.e"), ("p.a", "p.e"), ("p.s", "p.s"), ("p.s", "p.e"), ("p.a", "q.f")]
    imports = [("p.m0", "p.m1"), ("p.m1", "p.m2"), ("p.m0", "p.m2")]
    g = graph(spark, work, n, [edge(f"c{k}", a, b) for k, (a, b) in enumerate(calls)] + [edge(f"i{k}", a, b, "IMPORTS") for k, (a, b) in enumerate(imports)])
    assert rows(motifs.root_depths(motifs.domain_links(g, "CALLS"), work)) == [("p", "p.a", 3)]
    assert rows(motifs.root_depths(motifs.domain_links(g, "IMPORTS"), work)) == [("p", "p.m0", 2)]
    assert rows(motifs.fingerprint(g).select("domain", "chain_len", "dag_depth")) == [("p", 3.0, 2), ("q", 0.0, 0)]
