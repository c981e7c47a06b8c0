import random

from cairngraph.operators.references import orphan_counts, orphan_references
from tests.helpers import EDGES, NODES, day, edge, edges, node, nodes, rows


def brute(edge_rows, node_rows):
    out, first = set(), {}
    for e in edge_rows:
        if e[0] is not None:
            k = (e[0], e[1], e[2])
            first[k] = min(first.get(k, e[-1]), e[-1])
    for (i, s, t), at in first.items():
        for side, key in (("source", s), ("target", t)):
            if key is None or key.strip().startswith(("raw_", "self.")):
                continue
            mine = [n for n in node_rows if n[0] == key.strip()]
            if not any(n[-2] <= at and (n[-1] is None or n[-1] > at) for n in mine):
                out.add((i, side, "missing" if not mine else "late" if min(n[-2] for n in mine) > at else "deleted"))
    return sorted(out, key=str)


def test_against_brute_force(spark, work):
    rng = random.Random(3)
    ids = [f"n{i}" for i in range(8)]
    node_rows = []
    for i in ids[:6]:
        for _ in range(rng.randint(1, 4)):
            a = rng.randint(0, 20)
            node_rows.append(node(i, at=a, gone=rng.choice([None, a, a + rng.randint(1, 6)])))
    edge_rows = [edge(f"e{k}", rng.choice([*ids, None, "self.x"]), rng.choice([*ids, " n1\t", "raw_call:n1", ""]), at=rng.randint(0, 25)) for k in range(120)]
    edge_rows += [(*e[:-1], day(30)) for e in edge_rows[:20]]
    want = brute(edge_rows, node_rows)
    assert {r[2] for r in want} == {"missing", "late", "deleted"}
    for limit in (1 << 20, 0):
        got = orphan_references(edges(spark, edge_rows), nodes(spark, node_rows), work, limit)
        assert rows(got.select("edge_id", "side", "reason")) == want
    assert sum(r["n_refs"] for r in orphan_counts(got).collect()) == len(want)


def test_empty_tables(spark, work):
    none = spark.createDataFrame([], NODES)
    assert orphan_references(spark.createDataFrame([], EDGES), none, work).count() == 0
    got = orphan_references(edges(spark, [edge("1", "a", "b")]), none, work)
    assert rows(got.select("side", "reason")) == [("source", "missing"), ("target", "missing")]
