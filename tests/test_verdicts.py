from cairngraph.plans import graph_queries
from tests.helpers import edge, graph, node


def test_sparse_single_and_unlinked_packages(spark, work):
    pairs = [(f"{x}.m{k}", f"{x}.m{k + 1}") for x in ("dense", "sparse") for k in (0, 2)]
    n = [f"{x}.m{k}" for x in ("dense", "sparse") for k in range(4)] + [f"sparse.alone{k}" for k in range(5)] + ["single.m", "loose.a", "loose.b"]
    g = graph(spark, work, [node(i, "FILE") for i in n], [edge(f"i{k}", a, b, "IMPORTS") for k, (a, b) in enumerate(pairs)])
    got = {r["package"]: (round(r["modularity"], 3), round(r["connected"], 3), r["verdict"]) for r in graph_queries.layout_verdicts(g).collect()}
    assert got == {"dense": (0.5, 1.0, "split"), "sparse": (0.5, 0.444, "leave"), "single": (0.0, 0.0, "no_signal"), "loose": (0.0, 0.0, "no_signal")}
