import json
import uuid

from pyspark.sql import functions as F

from cairngraph.functions.paths import is_generated, is_skipped, is_test, matches_any, module_of
from cairngraph.operators.incremental import ChangeStore, file_log
from cairngraph.operators.uplift import uplift
from cairngraph.sources.python_source import extract, link, parse, read_tree
from cairngraph.sources.sinks import graph_json, mermaid, text_tree, write_json
from cairngraph.streaming.changes import FILES_STATE, call_counts, follow
from tests.helpers import day, edge, graph, node, rows

A = """import os
from pkg.b import Base, run as go
from typing import TYPE_CHECKING
if TYPE_CHECKING:
    import pkg.c

class K(Base):
    @staticmethod
    def make(): return K()
    def act(self):
        self.x = go(self.y)
        self.make()
        helper(act)

def helper(f):
    return os.path.join(f)
"""
B = "# Generated by hand. Do not edit.\nclass Base: pass\ndef run(x): return missing(x)\n"


def test_a_tree_is_read_and_linked(spark, tmp_path):
    for path, text in {"pkg/a.py": A, "pkg/b.py": B, "pkg/__init__.py": "", ".hidden/z.py": "x = 1", "build/q.py": "", "pkg/bad.py": "def ("}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    files = read_tree(spark, str(tmp_path))
    assert {r["file_path"] for r in files.collect()} == {"pkg/a.py", "pkg/b.py", "pkg/__init__.py", "pkg/bad.py"}
    nodes, edges = extract(files)
    got = {r["id"]: r for r in nodes.collect()}
    assert {i: r["type"] for i, r in got.items()} == {"pkg": "FILE", "pkg.bad": "FILE", "pkg.a": "FILE", "pkg.b": "FILE", "pkg.a.K": "CLASS", "pkg.a.K.make": "METHOD", "pkg.a.K.act": "METHOD", "pkg.a.helper": "FUNCTION", "pkg.b.Base": "CLASS", "pkg.b.run": "FUNCTION"}
    assert json.loads(got["pkg.a.K.act"]["metadata"])["self_attrs"] == ["make", "x", "y"]
    assert got["pkg.b"]["is_generated"] and not got["pkg.a"]["is_generated"]
    linked = {(r["type"], r["source"], r["target"]): r for r in link(nodes, edges).collect()}
    for want in [("EXTENDS", "pkg.a.K", "pkg.b.Base"), ("CALLS", "pkg.a.K.act", "pkg.b.run"), ("CALLS", "pkg.a.K.act", "pkg.a.K.make"), ("CALLS", "pkg.a.K.act", "pkg.a.helper"), ("CALLS", "pkg.a.K.make", "pkg.a.K"), ("CALLS", "pkg.b.run", "raw_call:missing"), ("IMPORTS", "pkg.a", "pkg.b"), ("IMPORTS_SYMBOL", "pkg.a", "pkg.b.Base"), ("DECLARES", "pkg.a.K", "pkg.a.K.act"), ("CONTAINS", "pkg.a", "pkg.a.K")]:
        assert want in linked, want
    assert linked["IMPORTS", "pkg.a", "raw_import:pkg.c"]["type_only"]
    assert linked["CALLS", "pkg.b.run", "raw_call:missing"]["confidence"] == 0.8


def test_no_python():
    assert [r[2] for r in parse("m", "def (\x00")] == ["FILE"]


def test_path_rules(spark):
    df = spark.createDataFrame([("a/tests/x.py", True), ("contest/x.py", False), ("a/test_x.py", True), ("a/testdata.py", False), ("conftest.py", True)], "p string, want boolean")
    assert df.where(is_test("p") != F.col("want")).count() == 0
    one = spark.createDataFrame([("src/a/__init__.py", "x\n" * 20 + "@generated")], "p string, t string").select(is_generated("t").alias("g"), module_of("p").alias("m"), is_skipped(F.lit("a/.git/b")).alias("s"), matches_any("p", ["src/*"]).alias("y"), matches_any("p", ["a*"]).alias("n")).first()
    assert tuple(one) == (False, "src.a", True, True, False)


def test_sinks(spark, work, tmp_path):
    g = graph(spark, work, [node("a"), node("b")], [edge("1", "a", "b"), edge("2", "a", "b", confidence=0.5), edge("3", "b", "a")])
    write_json(g.nodes, g.edges, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/edges")).count() == 3
    assert graph_json(g.nodes, g.edges).count() == 4
    assert text_tree("a", g.edges) == "a\n  b\n    a ↪"
    assert mermaid(g.edges).splitlines()[0] == "flowchart LR" and "n0 -->|CALLS| n1" in mermaid(g.edges)


def test_uplift(spark, work):
    g = graph(spark, work, [node("p.f", "FILE", file_path="p/f.py"), node("p.f.g", file_path="p/f.py"), node("q.h", file_path="q/h.py", domains=["own"])], [edge("1", "p.f", "p.f.g", "CONTAINS"), edge("2", "p.f.g", "q.h")])
    nodes, needs = uplift(g, {"pay": {"file_path_patterns": ["p/*"]}, "none": {}})
    assert {r["id"]: r["domains"] for r in nodes.collect()} == {"p.f": ["pay"], "p.f.g": ["pay"], "q.h": ["own"]}
    assert rows(needs) == [("pay", "own", 1)]


def test_a_stream_commits_each_batch_once(spark, tmp_path):
    src, store = str(tmp_path / "in"), ChangeStore(spark, f"file://{tmp_path}/store-{uuid.uuid4().hex}")
    put = lambda data: spark.createDataFrame([(i, p, h, day(s), day(a)) for i, p, h, s, a in data], FILES_STATE).coalesce(1).write.mode("append").parquet(src)
    put([(1, "a", "1", 1, 1), (2, "b", "1", 1, 1)])
    follow(spark, src, store, str(tmp_path / "cp")).awaitTermination()
    put([(3, "a", "2", 2, 2), (4, "b", "1", 2, 2), (5, "c", "1", 0, 0)])
    follow(spark, src, store, str(tmp_path / "cp")).awaitTermination()
    follow(spark, src, store, str(tmp_path / "cp")).awaitTermination()
    assert store.last().number == 2
    assert rows(store.output(1)) == [("a",), ("b",)] and rows(store.output(2)) == [("a",), ("c",)]


def test_a_stream_on_a_store_with_commits_loses_nothing(spark, tmp_path):
    src, store = str(tmp_path / "in"), ChangeStore(spark, f"file://{tmp_path}/store-{uuid.uuid4().hex}")
    put = lambda *data: spark.createDataFrame([(i, p, h, day(s), day(a)) for i, p, h, s, a in data], FILES_STATE).coalesce(1).write.mode("append").parquet(src)
    report = lambda i, p: file_log(spark.createDataFrame([(i, p, "1", day(1), day(1))], FILES_STATE))
    for i in range(5):
        store.apply(report(i, f"old{i}"), store.last(), None)
    for i in range(3):
        put((10 + i, f"new{i}", "1", 2, 2))
        follow(spark, src, store, str(tmp_path / "cp")).awaitTermination()
        store.apply(report(20 + i, f"between{i}"), store.last(), None)
    assert [rows(store.output(n)) for n in (6, 8, 10)] == [[("new0",)], [("new1",)], [("new2",)]]
    assert store.last().number == 11


def test_windowed_counts(spark, tmp_path):
    spark.createDataFrame([(" calls", day(0)), ("CALLS", day(0)), ("IMPORTS", day(3))], "type string, ingested_at timestamp").write.parquet(str(tmp_path / "e"))
    stream = call_counts(spark.readStream.schema("type string, ingested_at timestamp").parquet(str(tmp_path / "e")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.sql("select type, n_edges from counts")) == [("CALLS", 2), ("IMPORTS", 1)]
