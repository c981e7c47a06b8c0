import threading

import pytest

from cairngraph import workspace
from cairngraph.workspace import Workspace, listing, publish, read_text, shared_folder, version
from tests.helpers import rows


def test_tables_go_with_their_workspace(spark):
    with Workspace(spark, "t") as w:
        kept = w.save(spark.range(3).toDF("id"))
        cut = w.save_bucketed(spark.range(9).selectExpr("id", "id % 3 as k"), "k", 4)
        assert kept.count() == 3 and "Exchange" not in cut.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
        assert len(listing(spark, w.root)) == 2
        w.drop(kept)
        assert len(listing(spark, w.root)) == 1
    assert listing(spark, w.root) == []


def test_a_file_is_made_once_and_whole(spark, tmp_path):
    path, said = f"file://{tmp_path}/c/1.json", []
    go = lambda i: said.append(publish(spark, path, f"writer {i}"))
    all_ = [threading.Thread(target=go, args=(i,)) for i in range(8)]
    [t.start() for t in all_]
    [t.join() for t in all_]
    assert sorted(said) == [False] * 7 + [True]
    assert read_text(spark, path).startswith("writer ") and listing(spark, f"file://{tmp_path}/c") == ["1.json"]


def test_the_same_by_a_rename_that_refuses(spark, tmp_path):
    path = f"file://{tmp_path}/d/1.json"
    assert publish(spark, path, "one", linked=False) and not publish(spark, path, "two", linked=False) and not publish(spark, path, "three")
    assert read_text(spark, path) == "one" and listing(spark, f"file://{tmp_path}/d") == ["1.json"]


def test_versions(spark, tmp_path):
    at = f"file://{tmp_path}/t.parquet"
    assert version(spark, at) == (0, 0, 0)
    spark.range(3).write.parquet(at)
    one = version(spark, at)
    spark.range(3).write.mode("append").parquet(at)
    assert version(spark, at) != one and rows(spark.read.parquet(at).groupBy().count()) == [(6,)]


class Stub:
    """As much of a session as tells where its folder is."""

    def __init__(self, master, said=None, set_=None):
        self.said, self.set, self.master = said, set_, master
        self.conf = self.sparkContext = self._jsc = self

    def get(self, *_):
        return self.said if _ else self.set

    def sc(self):
        return self

    def getCheckpointDir(self):  # noqa: N802 - the context's own name
        return self

    def isDefined(self):  # noqa: N802
        return self.set is not None


def test_a_cluster_must_name_its_folder(monkeypatch):
    monkeypatch.setattr(workspace, "_own", ["file:///tmp/own"])
    with pytest.raises(RuntimeError):
        shared_folder(Stub("yarn"))
    assert shared_folder(Stub("local[4]")) == "file:///tmp/own"
    assert shared_folder(Stub("yarn", "hdfs://n/c/")) == "hdfs://n/c" and shared_folder(Stub("yarn", None, "hdfs://n/d")) == "hdfs://n/d"
