from cairngraph.operators.hierarchy import descendant_pairs, node_hierarchies, node_paths
from cairngraph.plans import core_queries
from tests.helpers import edge, edges, rows


def test_descendants_and_endless_paths(spark, work, tmp_path):
    parents = {f"n{i}": f"n{(i - 1) // 3}" for i in range(1, 30)} | {f"x{i}": f"x{i - 1}" for i in range(1, 9)} | {"c1": "c2", "c2": "c1", "d": "c1"}
    e = edges(spark, [edge(c, p, c, "CONTAINS") for c, p in parents.items()])
    want = set()
    for c in parents:
        x = c
        while x in parents and c not in ("c1", "c2", "d"):
            x = parents[x]
            want.add(("containment", x, c))
    got = rows(descendant_pairs(work.save(node_hierarchies(e, work))))
    assert len(got) == len(want) and set(got) == want
    assert {r[1] for r in rows(node_paths(e, work)) if r[2] is None} == {"c1", "c2", "d"}
    e.write.parquet(str(tmp_path / "edges.parquet"))
    assert {"entry", "exit", "n_descendants"} < set(core_queries.QUERIES["p4_intervals"](spark, str(tmp_path)).columns)
