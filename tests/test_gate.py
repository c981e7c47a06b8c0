from cairngraph.plans import graph_queries
from tests.helpers import edge, graph, node


def test_a_domain_that_breaches_only_the_tangle_limit(spark, work):
    n = [node(f"{d}.{x}") for d in "pq" for x in "abc"]
    both = [(f"p.{x}", f"p.{y}") for x in "abc" for y in "abc" if x != y] + [("q.a", "q.b"), ("q.b", "q.c")]
    g = graph(spark, work, n, [edge(f"c{k}", a, b) for k, (a, b) in enumerate(both)])
    got = {r["domain"]: r for r in graph_queries.hygiene_gate_whole(g).collect()}
    assert (got["p"]["tangle_ratio"], got["p"]["breaches"], got["p"]["failed"]) == (1.0, "tangle_ratio", True)
    assert (got["q"]["tangle_ratio"], got["q"]["failed"]) == (0.0, False)
    assert {r["domain"] for r in graph_queries.hygiene_gate(g).where("failed").collect()} == {"p"}
