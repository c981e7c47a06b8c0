from cairngraph.operators import structure
from tests.helpers import edge, graph, node, rows


def test_package_graphs_link_by_suffix(spark, work):
    n = [node(i, "FILE") for i in ("p.a", "p.sub.b", "p.x.c", "p.y.c", "q.sub.b", "q.d")]
    links = [("p.a", "sub.b"), ("p.a", "c"), ("src.p.a", "p.x.c"), ("q.d", "src.q.sub.b")]
    g = graph(spark, work, n, [edge(f"i{k}", a, b, "IMPORTS") for k, (a, b) in enumerate(links)])
    got = structure.package_graphs(g)[0]
    assert rows(got.where("a < b")) == [("p", "p.a", "p.sub.b", 1.0), ("p", "p.a", "p.x.c", 1.0), ("q", "q.d", "q.sub.b", 1.0)]
    for p in "pq":
        assert rows(got.where(got.package == p).select("a", "b", "weight")) == rows(structure.file_graph(g, p))
