import re

import pytest
from pyspark.sql import functions as F

from cairngraph.operators import motifs, skew
from cairngraph.plans import graph_queries
from tests.helpers import graph, node, rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def broadcast(df):
    """What lies below each broadcast of the plan."""
    lines = plan(df).splitlines()
    depth = lambda x: len(re.match(r"[ :|+-]*", x)[0])
    out = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = lines[i + 1 :]
            out.append("\n".join(below[: next((k for k, x in enumerate(below) if depth(x) <= depth(line)), len(below))]))
    return out


@pytest.fixture
def ids(spark):
    """Deep ids below few prefixes, prefixes within each other, blank parts, and ids under none."""
    many = [f"p.a.{'x.' * (i % 9)}f{i}" for i in range(60)]
    return [*many, "p", "p.a", "p.ab", "p.ab.c", "p.a.x", "q.z", "", ".", ".f", "p.", "p..a", "none.at.all", "é.ü.a"]


PREFIXES = ["p", "p.a", "p.a.x.x", "q", "", "p.", "é.ü", "p.a.", "nowhere"]


def longest(i):
    under = [p for p in PREFIXES if i == p or i.startswith(p + ".")]
    return (i, max(under, key=len)) if under else None


@pytest.mark.parametrize("bound, per_salt", [(None, None), (0, None), (0, 10)])
def test_each_id_has_its_longest_prefix(spark, work, ids, monkeypatch, bound, per_salt):
    if bound is not None:
        monkeypatch.setattr(skew, "BROADCAST_BYTES", bound)
    if per_salt:
        monkeypatch.setattr(skew, "ROWS_PER_SALT", per_salt)
    prefixes = spark.createDataFrame([(p, p) for p in PREFIXES], "domain string, prefix string")
    found = motifs.assign_domains(spark.createDataFrame([(i,) for i in ids], "id string"), prefixes, work)
    assert rows(found) == sorted((x for i in ids if (x := longest(i))), key=str)
    # However few bytes the ids' file has, their heads are never what is sent to every executor.
    assert not any("Generate" in x for x in broadcast(found))
    assert ("BroadcastHashJoin" in plan(found)) == (bound is None or per_salt is not None)


@pytest.mark.parametrize("bound", [8 << 20, 0])
def test_the_query_never_broadcasts_heads(spark, work, monkeypatch, bound):
    monkeypatch.setattr(skew, "BROADCAST_BYTES", bound)
    n = [node("p.a", "FILE"), node("p.b.c", "FILE"), node("r", "FILE"), node("p.a.f"), node("p.b.c.g"), node("p.b"), node("r.s"), node("q.t"), node("p.gone", gone=1)]
    df = graph_queries.domain_assignment(graph(spark, work, n, []))
    assert not any("Generate" in x for x in broadcast(df))
    assert bool(broadcast(df)) == bool(bound)
    assert rows(df) == [("p", 2), ("p.b", 3), ("r", 2)]
    assert df.agg(F.sum("n")).first()[0] == 7
