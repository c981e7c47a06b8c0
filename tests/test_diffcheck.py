import math
import random

from cairngraph.operators.diffcheck import KEY_KIND, diff_check, key_items, line_index, parse_diffs
from tests.helpers import edge, graph, node, rows

DIFF = """diff --git a/p/a.py b/p/a.py
--- a/p/a.py
+++ b/p/a.py
@@ -3,2 +3,3 @@ def f():
-x = 1
+x = 2
+y = 3
 z
@@ -20 +21 @@
-gone
+++ kept
diff --git a/old.py b/new.py
similarity index 100%
rename from old.py
rename to new.py
diff --git a/dead.py b/dead.py
deleted file mode 100644
--- a/dead.py
+++ /dev/null
@@ -1,2 +0,0 @@
-a
-b
"""


def test_hunks(spark):
    got = parse_diffs(spark.createDataFrame([(DIFF,), (None,), ("no diff",)], "diff string"))
    assert rows(got.where("line is not null").select("old_path", "new_path", "side", "line")) == sorted([("dead.py", None, "old", 1), ("dead.py", None, "old", 2), ("p/a.py", "p/a.py", "context", 5), ("p/a.py", "p/a.py", "new", 21), ("p/a.py", "p/a.py", "new", 3), ("p/a.py", "p/a.py", "new", 4), ("p/a.py", "p/a.py", "old", 20), ("p/a.py", "p/a.py", "old", 3)], key=str)
    assert rows(got.where("line is null").select("old_path", "new_path")) == [("dead.py", None), ("old.py", "new.py"), ("p/a.py", "p/a.py")]
    assert rows(line_index(got)) == [("p/a.py", 21, "++ kept"), ("p/a.py", 3, "x = 2"), ("p/a.py", 4, "y = 3"), ("p/a.py", 5, "z")]


def test_check(spark, work):
    g = graph(
        spark,
        work,
        [node("p.a.f", file_path="p/a.py", lines=(1, 9)), node("p.a.C", "CLASS", file_path="p/a.py", lines=(20, 30)), node("q.D", "CLASS", file_path="q.py", lines=(1, 5)), node("q.E", "CLASS", file_path="q.py", lines=(6, 9)), node("q.u", file_path="q.py", lines=(40, 44)), node("t.t", file_path="t.py", test=True), node("dead.g", file_path="EXTERNAL", namespace="UNKNOWN")],
        [edge("1", "q.u", "p.a.f", line=41), edge("2", "q.u", "p.a.f", line=42, confidence=0.5), edge("3", "t.t", "p.a.f", line=1), edge("4", "p.a.f", "p.a.f"), edge("5", "q.D", "p.a.C", "EXTENDS"), edge("6", "q.E", "q.D", "EXTENDS", line=6), edge("7", "q.u", "dead.g", confidence=0.8), edge("8", "q.none", "p.a.f")],
    )
    base = spark.createDataFrame([("dead.g", "FUNCTION", "g", "dead.py", 1, 2), ("p.a.f", "FUNCTION", "f", "p/a.py", 1, 9), ("p.a.gone", "FUNCTION", "gone", "p/a.py", 50, 60)], "id string, type string, name string, file_path string, start_line int, end_line int")
    found = diff_check(g, parse_diffs(spark.createDataFrame([(DIFF,)], "diff string")), base)
    assert [(r["nth"], r["kind"], r["changed"], r["site"], r["file"], r["line"], r["score"]) for r in found.items.orderBy("nth").collect()] == [(1, "subclass", "p.a.C", "q.D", "q.py", 1, 1.0), (2, "caller", "p.a.f", "q.u", "q.py", 41, 1.0), (3, "caller", "dead.g", "q.u", "q.py", 40, 0.8), (4, "subclass", "p.a.C", "q.E", "q.py", 6, 0.5)]
    assert {r["reason"] for r in found.items.collect()} >= {"calls g, which this diff removed", "extends C, which this diff changed (2 levels)"}
    assert rows(found.summary) == [(3, 0, 4, 1)]
    none = diff_check(g, parse_diffs(spark.createDataFrame([], "diff string")), base)
    assert none.items.count() == 0 and rows(none.summary) == [(0, 0, 0, 0)]


COMMON = {"id", "name", "type", "data", "value", "key", "items", "result"}


def brute(edges, uses, renamed):
    """The rules for key items, one by one."""
    parse = lambda k: tuple(k[4:].split("|", 1))
    agree = lambda a, b: a == b or not a or not b
    test = lambda f: "tests/" in f
    keys = {k for k, *_ in edges} | {u[0] for u in uses}
    files = {k: len({f for k2, _, _, f, _, _ in edges if k2 == k and f and not test(f)}) for k in keys}
    spec = lambda k: parse(k)[1].count(".") + 1 + bool(parse(k)[0]) - math.log2(max(files[k], 1))
    dropped = lambda k: not parse(k)[0] and (all(p in COMMON for p in parse(k)[1].split(".")) or files[k] > 8)
    uses = [u for u in uses if not test(u[3])]
    out = []
    declared = {(parse(k)[1], parse(k)[0]) for k, t, *_ in edges if t == "DECLARES_KEY"}
    is_declared = lambda ns, p: any(p2 == p and agree(ns, n2) for p2, n2 in declared)
    mapped = [(k, f, c) for k, t, _, f, _, c in edges if t == "DECLARES_KEY" and f.endswith(".json") and (parse(k)[0] or c)]
    for key in {u[0] for u in uses}:
        ns, path = parse(key)
        mine = [u for u in uses if u[0] == key]
        for m in keys:
            n2, p2 = parse(m)
            below = p2.startswith(path + ".")
            if dropped(key) or dropped(m) or not agree(ns, n2) or not (below or p2 == path):
                continue
            for k, t, s, f, line, c in edges:
                if k == m and s not in {u[2] for u in mine} and (not below or t == "READS_KEY"):
                    out.append((KEY_KIND[t][0], s, m, min(spec(key), spec(m))))
                if k == m and not below and t == "READS_KEY" and any(u[4] and u[1] == "DECLARES_KEY" for u in mine) and not is_declared(ns, path):
                    out.append(("removed-declaration", s, m, min(spec(key), spec(m))))
    touched = {renamed.get(u[3], u[3]) if u[4] else u[3] for u in uses if u[1] == "DECLARES_KEY"}
    for k, t, s, f, line, c in edges:
        ns, path = parse(k)
        parent = path.rpartition(".")[0]
        asked = any(u[0] == k and u[1] == "READS_KEY" and not u[4] for u in uses) or any(f2 in touched and parse(k2)[1] == parent and agree(parse(k2)[0], ns) for k2, f2, _ in mapped)
        if t == "READS_KEY" and parent and asked and any(parse(k2)[1] == parent and agree(parse(k2)[0], ns) for k2, _, _ in mapped) and not is_declared(ns, path):
            out.append(("undeclared-read", s, k, spec(k)))
    ranks = {"removed-declaration": 0, "undeclared-read": 1}
    first = {}
    for kind, s, k, _ in out:
        if kind in ranks:
            first[s, k] = min(first.get((s, k), 9), ranks[kind])
    best = {}
    for kind, s, k, score in out:
        if (s, k) not in first or ranks.get(kind) == first[s, k]:
            best[kind, s] = max(best.get((kind, s), -99.0), score)
    return sorted((kind, s, round(v, 6)) for (kind, s), v in best.items())


def test_key_items_against_brute_force(spark, work):
    rng = random.Random(8)
    paths = ["a", "a.b", "a.b.c", "id", "data.id", "q.keyword", "q", "a.d"]
    found = set()
    for _ in range(4):
        edges = [(f"key:{rng.choice(['', '', 'n', 'm'])}|{rng.choice(paths)}", rng.choice(list(KEY_KIND)), f"s{rng.randint(0, 14)}", rng.choice(["x.py", "y.py", "m.json", "k.json", "tests/t.py"]), rng.randint(1, 9), rng.choice(["", "object", "keyword"])) for _ in range(40)]
        uses = [(*rng.choice(edges)[:4], rng.random() < 0.5) for _ in range(6)]
        uses = [(k, t, s, "was.json" if b and f == "m.json" else f, b) for k, t, s, f, b in uses]
        e = spark.createDataFrame(edges, "key string, type string, source string, file string, line int, context string").selectExpr("*", "substring_index(substr(key, 5), '|', 1) as namespace", "substring_index(key, '|', -1) as path")
        u = spark.createDataFrame(uses, "key string, type string, source string, file string, base boolean")
        r = spark.createDataFrame([("was.json", "m.json")], "old_path string, new_path string")
        got = sorted((x["kind"], x["site"], round(x["score"], 6)) for x in key_items(e, u, r, work).collect())
        assert got == brute(edges, uses, {"was.json": "m.json"})
        found |= {k for k, *_ in got}
    assert len(found) >= 4
    assert key_items(e.where("false"), u.where("false"), r, work).count() == 0
