import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairngraph.operators.snapshots import SnapshotStore, graph_changes, key_ordinals, pack, snapshot_changes, unpack
from tests.helpers import day, rows

SNAP = "snapshot_no int, id string, type string, name string, file_path string, start_line int, end_line int, delivered_at timestamp"


@given(st.sets(st.integers(0, 4095)))
def test_bitmaps_come_back(places):
    bits = unpack(pack(np.array(sorted(places), dtype=int), 4096), 4096)
    assert set(np.flatnonzero(bits)) == places


def test_containers_are_small():
    assert len(pack(np.arange(4096), 4096)) < 16 and len(pack(np.array([5]), 4096)) < 16
    assert len(pack(np.arange(0, 4096, 2), 4096)) <= 513


def brute(data):
    one = {}
    for no, i, p, line, at in data:
        if no is not None and i is not None:
            p = p.replace("\\", "/").removeprefix("./") if p else p
            k = (at is not None, at or 0, p is not None, p or "", line is not None, str(line))
            if (no, i) not in one or k > one[no, i][0]:
                one[no, i] = (k, (p, line))
    numbers = sorted({n for n, _ in one})
    out = []
    for a, b in zip(numbers, numbers[1:]):
        was, now = ({i: v for (n, i), (_, v) in one.items() if n == x} for x in (a, b))
        out += [(b, i, "added") for i in now if i not in was] + [(b, i, "removed") for i in was if i not in now] + [(b, i, "changed") for i in now if i in was and was[i] != now[i]]
    return sorted(out, key=str)


def test_against_brute_force(spark, work):
    rng = random.Random(5)
    data = [(rng.choice([1, 3, 4, 9]), f"i{rng.randint(0, 40)}", rng.choice(["a", "./a", "x\\y", "x/y", None]), rng.choice([None, 1, 2]), rng.randint(0, 200)) for _ in range(250)] + [(None, "i1", "a", 1, 1), (1, None, "a", 1, 1)]
    df = spark.createDataFrame([(n, i, None, None, p, line, None, day(at)) for n, i, p, line, at in data], SNAP)
    assert rows(graph_changes(df, work)) == brute(data)
    small = snapshot_changes(df.withColumn("key", F.lit(1)), "snapshot_no", "id", {"p": F.col("file_path"), "l": F.col("start_line")}, "delivered_at", work, chunk=8)
    assert {r[0] for r in rows(small)} <= {3, 4, 9}


def test_a_store_compares_what_is_new(spark, work):
    folder, of = f"{work.root}/kept", lambda *r: spark.createDataFrame([(n, i, None, None, p, line, None, day(at)) for n, i, p, line, at in r], SNAP)
    assert rows(graph_changes(of((1, "a", "f", 1, 1), (1, "b", "f", 2, 1), (2, "a", "f", 1, 2)), work, folder)) == [(2, "b", "removed")]
    store = SnapshotStore(spark, folder, ["v0", "v1"])
    first = dict(rows(store.ordinals()))
    assert rows(graph_changes(of((5, "a", "g", 1, 1), (5, "c", "f", 2, 1)), work, folder)) == [(5, "a", "changed"), (5, "c", "added")]
    assert rows(graph_changes(of((6, "c", "f", 2, 1), (7, "b", "f", 2, 1)), work, folder)) == [(6, "a", "removed"), (7, "b", "added"), (7, "c", "removed")]
    then = dict(rows(store.ordinals()))
    assert {k: then[k] for k in first} == first and sorted(then.values()) == [0, 1, 2]
    assert rows(graph_changes(of(), work, folder)) == []
    assert rows(graph_changes(of((8, "b", "f", 2, 1)), work, folder)) == []
    with pytest.raises(ValueError):
        graph_changes(of((6, "z", "f", 1, 1)), work, folder)


def test_one_snapshot_and_none(spark, work):
    assert graph_changes(spark.createDataFrame([], SNAP), work).count() == 0
    assert graph_changes(spark.createDataFrame([(1, "a", None, None, "p", 1, 1, day(1))], SNAP), work).count() == 0


def test_ordinals_persist(spark, work):
    first = key_ordinals(spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "key string"), None, work)
    then = key_ordinals(spark.createDataFrame([("b",), ("c",), ("d",)], "key string"), first, work)
    old, new = dict(rows(first)), dict(rows(then))
    assert {k: new[k] for k in old} == old and sorted(new.values()) == [0, 1, 2, 3]
