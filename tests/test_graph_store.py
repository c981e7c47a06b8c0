import uuid

import pytest
from pyspark.sql import functions as F

from cairngraph.operators.graph_store import GraphStore, Refused, Version, ingest_mark, migrated, stale_files
from tests.helpers import edge, edges, node, nodes, rows


def store(spark, tmp_path):
    return GraphStore(spark, f"file://{tmp_path}/g-{uuid.uuid4().hex}")


def files(spark, *pairs):
    return spark.createDataFrame(list(pairs), "file_path string, hash string")


def test_whole_and_by_type(spark, tmp_path):
    s = store(spark, tmp_path)
    assert s.nodes() is None and s.edges() is None and s.files().count() == 0
    s.save(nodes(spark, [node("a"), node("d", "DOMAIN_CONCEPT")]), edges(spark, [edge("1", "a", "a"), edge("2", "a", "b", "DISPATCHES"), edge("3", "a", "b", "DOMAIN_DEPENDS_ON")]))
    assert rows(s.edges("CALLS").select("id", "type")) == [("1", "CALLS")]
    before = s.version().edges["CALLS"]
    s.replace_type("DISPATCHES", edges(spark, [edge("9", "a", "c", "DISPATCHES"), edge("8", "a", "c", "CALLS")]))
    assert rows(s.edges().select("id")) == [("1",), ("3",), ("9",)] and s.version().edges["CALLS"] == before
    s.replace_type("DISPATCHES", edges(spark, [edge("8", "a", "c", "CALLS")]))
    s.drop_uplift()
    assert rows(s.edges().select("id")) == [("1",)] and rows(s.nodes().select("id")) == [("a",)]
    s.sweep()
    assert s.nodes().count() == 1
    s.clear()
    assert s.nodes() is None


def test_batches(spark, tmp_path):
    s = store(spark, tmp_path)
    s.save_batch(nodes(spark, [node("a", file_path="a.py"), node("b", file_path="b.py"), node("x", file_path="EXTERNAL", namespace="UNKNOWN")]), edges(spark, [edge("1", "a", "b", file_path="a.py"), edge("2", "b", "a", file_path="b.py"), edge("3", "b", "x", file_path="a.py"), edge("4", "b", "x")]), files(spark, ("a.py", "1"), ("b.py", "1")))
    s.save_batch(nodes(spark, [node("a2", file_path="a.py"), node("x", file_path="EXTERNAL", namespace="STDLIB")]), edges(spark, [edge("5", "a2", "b", file_path="a.py")]), files(spark, ("a.py", "2")), state={"k": 1})
    assert rows(s.nodes().select("id", "namespace")) == [("a2", "INTERNAL"), ("b", "INTERNAL"), ("x", "STDLIB")]
    assert rows(s.edges().select("id")) == [("2",), ("4",), ("5",)] and rows(s.files()) == [("a.py", "2"), ("b.py", "1")] and s.state("k") == 1
    s.save_batch(nodes(spark, []), edges(spark, []), files(spark), gone=spark.createDataFrame([("b.py",)], "file_path string"))
    assert rows(s.nodes().select("id")) == [("a2",), ("x",)] and rows(s.edges().select("id")) == [("5",)] and rows(s.files()) == [("a.py", "2")]


def test_of_two_changes_one_is_refused(spark, tmp_path):
    s = store(spark, tmp_path)
    s.record("a", {"z": 1, "b": [2]})
    with pytest.raises(Refused):
        s._publish(Version(1))
    assert s.state("a") == {"b": [2], "z": 1} and s.state("none", 5) == 5
    with pytest.raises(ValueError):
        s.record("last_ingest", 1)
    s.record_ingest("/w/app", 5.0, ["pkg"])
    assert s.state("last_ingest") == {"root": "/w/app", "mark": 5.0} and s.state("a")["z"] == 1


def test_marks_and_staleness(spark):
    times = lambda *t: spark.createDataFrame([(x,) for x in t], "mtime double")
    mark = lambda *t, now=99.0: ingest_mark(times(*t), 10.0, now).first()[0]
    assert mark(3.0, 7.0) == 7.0 and mark() == 10.0 and mark(3.0, now=2.0) == 2.0
    assert 11.9 < mark(3.0, 12.0, 15.0) < 12.0
    found = spark.createDataFrame([("a", 1.0), ("b", 9.0), ("n", 1.0)], "file_path string, mtime double")
    assert rows(stale_files(files(spark, ("a", ""), ("b", ""), ("c", "")), found, 5.0)) == [("b", "changed"), ("c", "missing"), ("n", "new")]
    old = migrated(spark.createDataFrame([("a", 1)], "id string, odd int"), {"id": ("string", None), "is_test": ("boolean", False)})
    assert rows(old) == [("a", 1, False)] and dict(old.dtypes)["is_test"] == "boolean" and F is not None
