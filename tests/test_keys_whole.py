from cairngraph.operators import keys
from cairngraph.plans import graph_queries
from tests.helpers import edge, graph, node


def test_unscoped_common_keys_are_dropped(spark, work):
    g = graph(spark, work, [], [edge(f"k{k}", "p.f", t, "READS_KEY") for k, t in enumerate(["key:|data.id", "key:|order.id", "key:api|data.id", "key:|id"])])
    got = {r["key"]: r["dropped"] for r in keys.key_specificity(keys.key_sites(g)).collect()}
    assert got == {"key:|data.id": True, "key:|order.id": False, "key:api|data.id": False, "key:|id": True}


def test_coverage_counts_beyond_one_step(spark, work):
    ids = [graph_queries.HUB, "p.a", "p.b", "p.c"]
    calls = [("p.a", ids[0]), ("p.b", "p.a"), ("p.c", "p.b"), ("p.x", "raw_call:b")]
    g = graph(spark, work, [node(i) for i in ids], [edge(f"c{k}", a, b) for k, (a, b) in enumerate(calls)])
    assert graph_queries.impact_coverage_whole(g).collect() == [(3, 1)]
