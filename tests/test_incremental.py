import threading
import uuid

import pytest
from pyspark.sql import functions as F

from cairngraph.operators.incremental import ChangeLog, ChangeStore, changed_counts, changed_files, file_log
from cairngraph.workspace import listing, shared_folder
from tests.helpers import day, rows

LOG = "state_id long, file_path string, hash string, scanned_at timestamp, arrived_at timestamp"
RUNS = "run_id int, started_at timestamp, finished_at timestamp, status string"


def log(spark, data):
    return spark.createDataFrame([(i, p, h, day(s), day(a)) for i, p, h, s, a in data], LOG)


def runs(spark, data):
    return spark.createDataFrame([(i, day(a), None, s) for i, a, s in data], RUNS)


DATA = [
    (1, "./a//b", "X ", 1, 1), (2, "a\\b", "x", 2, 2), (3, "c", "1", 1, 1), (4, "c", None, 3, 3), (5, "c", "", 4, 4), (6, "c", "1", 6, 6), (7, "d", "9", 5, 5), (8, "d", "8", 4, 7),
    (9, "e", "", 1, 1), (10, "A/b", "q", 8, 8), (11, "f", "1", 2, 9), (12, "f", "2", 2, 9), (13, None, "z", 1, 1),
]


def test_runs(spark):
    got = changed_files(log(spark, DATA), runs(spark, [(1, 1, "ok"), (2, 2, "failed"), (3, 4, "ok"), (4, 5, "aborted"), (5, 6, "ok"), (6, 7, "ok"), (7, 9, "ok")]), spark)
    assert rows(got) == [(1, "a/b"), (1, "c"), (5, "c"), (5, "d"), (7, "A/b"), (7, "f")]
    assert rows(changed_counts(got))[0] == (1, 2, 2)


def test_empty(spark):
    assert changed_files(log(spark, []), runs(spark, [(1, 1, "ok")]), spark).count() == 0
    assert changed_files(log(spark, DATA), runs(spark, [(1, 1, "failed")]), spark).count() == 0


def test_a_run_that_fails_changes_nothing(spark):
    store = ChangeStore(spark, f"{shared_folder(spark)}/t-{uuid.uuid4().hex}", compact_every=2)
    rows_ = file_log(log(spark, DATA))

    def fail():
        raise OSError("lost")

    assert store.run(rows_, F.col("arrived_at"), day(1)) == 1
    with pytest.raises(OSError):
        store.run(rows_, F.col("arrived_at"), day(6), before_commit=fail)
    assert listing(spark, f"{store.folder}/commit") == ["0000000001.json"]
    assert store.run(rows_, F.col("arrived_at"), day(6)) == 2
    assert rows(store.output(2)) == [("d",)]  # c is as it was at the run before
    assert store.last().watermark == day(6)
    assert store.run(rows_, F.col("arrived_at"), day(6)) == 3
    assert store.output(3).count() == 0  # nothing is repeated
    assert store.run(rows_, F.col("arrived_at"), day(9)) == 4
    assert rows(store.output(4)) == [("A/b",), ("f",)]


def test_two_runs_cannot_both_commit(spark):
    store = ChangeStore(spark, f"{shared_folder(spark)}/t-{uuid.uuid4().hex}")
    rows_ = file_log(log(spark, DATA))
    with pytest.raises(RuntimeError):
        store.run(rows_, F.col("arrived_at"), day(1), before_commit=lambda: store.run(rows_, F.col("arrived_at"), day(1)))
    assert store.last().number == 1


def test_two_threads_one_wins(spark):
    store = ChangeStore(spark, f"{shared_folder(spark)}/t-{uuid.uuid4().hex}")
    rows_, meet, said = file_log(log(spark, DATA)), threading.Barrier(2), []

    def go():
        try:
            said.append(store.run(rows_, F.col("arrived_at"), day(9), before_commit=meet.wait))
        except RuntimeError:
            said.append("lost")

    both = [threading.Thread(target=go) for _ in range(2)]
    [t.start() for t in both]
    [t.join() for t in both]
    assert sorted(said, key=str) == [1, "lost"]
    assert rows(store.output(1)) == [("A/b",), ("a/b",), ("c",), ("d",), ("f",)]
    before = len(listing(spark, store.folder))
    store.sweep()
    assert len(listing(spark, store.folder)) <= before and store.output(1).count() == 5


def test_a_log_commit_is_read_once_whenever_it_is_written(spark):
    folder = f"{shared_folder(spark)}/t-{uuid.uuid4().hex}"
    source, store = ChangeLog(spark, f"{folder}/log"), ChangeStore(spark, f"{folder}/store", compact_every=2, bucket_keys=2)
    put = lambda *data: source.append(file_log(log(spark, data)))
    assert source.last() == 0
    put((1, "a", "1", 1, 1), (2, "b", "1", 1, 1), (3, "x", "1", 1, 1), (4, "y", "1", 1, 1), (5, "z", "1", 1, 1))
    assert store.run(source, None, source.last()) == 1
    put((6, "c", "1", 1, 1))  # of the very moment of the run before
    assert store.run(source, None, source.last()) == 2 and rows(store.output(2)) == [("c",)]
    put((7, "a", "2", 2, 1))
    put((8, "a", "1", 3, 1))
    assert store.run(source, None, 3) == 3 and rows(store.output(3)) == [("a",)]
    assert store.last().buckets == 3
    assert store.run(source, None, 4) == 4 and rows(store.output(4)) == [("a",)]
    assert store.run(source, None, 4) == 5 and store.output(5).count() == 0
    put()
    assert store.run(source, None, source.last()) == 6 and store.output(6).count() == 0
