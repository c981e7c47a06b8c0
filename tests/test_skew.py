import pytest
from pyspark.sql import functions as F

from cairngraph.operators import skew
from cairngraph.operators.skew import Extent, extent, hot_keys, sized_join, split_join
from tests.helpers import rows


@pytest.fixture(scope="module")
def sides(spark):
    """300,000 keys, one of which has 60,000 rows more, and one without partner that has as many."""
    big = spark.range(300_000).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v"))
    hot = spark.range(60_000).select(F.lit("k7").alias("k"), F.col("id").alias("v"))
    lone = spark.range(60_000).select(F.lit("alone").alias("k"), F.col("id").alias("v"))
    none = spark.range(60_000).select(F.lit(None).cast("string").alias("k"), F.col("id").alias("v"))
    small = spark.range(300_000).select(F.concat(F.lit("k"), "id").alias("k"), (F.col("id") * 2).alias("w"))
    return big.unionByName(hot).unionByName(lone).unionByName(none), small


def test_only_hot_keys_are_sent(sides, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_SALT", 50_000)
    big, small = sides
    hot = hot_keys(big.groupBy("k").agg(F.count("*").alias("n")), ["k"])
    assert len(hot) == 3
    joined = split_join(big, small, ["k"], "inner", hot)
    assert joined.count() == 360_000 and joined.agg(F.sum("w")).first()[0] == 2 * sum(range(300_000)) + 14 * 60_000
    # What is sent to the executors: the hot keys' rows of the small side, and the marks.
    sent = small.where(F.xxhash64("k").isin(hot))
    assert sent.count() == 1


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_every_kind_of_join(spark, how, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_SALT", 5)
    big = spark.createDataFrame([("a", i) for i in range(20)] + [("b", 1), (None, 1), ("c", 2)] + [("z", i) for i in range(9)] + [(None, 7)] * 8, "k string, v long")
    small = spark.createDataFrame([("a", "A"), ("b", "B"), ("y", "Y"), (None, "N")], "k string, w string")
    want = rows(big.join(small, "k", how))
    assert rows(sized_join(big, small, ["k"], how, Extent(4, 1 << 40))) == want
    assert rows(sized_join(big, small, ["k"], how, extent(small))) == want
    assert rows(sized_join(big, small, ["k"], how, None, big_rows=3)) == want


def test_extent_and_bounds(spark, monkeypatch):
    df = spark.createDataFrame([("abc", 1), (None, 2)], "k string, v long")
    assert extent(df) == Extent(2, 2 * 48 + 3)
    assert extent(df.where("false")) == Extent(0, 0)
    monkeypatch.setattr(skew, "ROWS_PER_SALT", 1)
    monkeypatch.setattr(skew, "MOST_HOT", 2)
    counts = spark.createDataFrame([(str(i), 10) for i in range(9)] + [("x", 120)], "k string, n long")
    assert len(hot_keys(counts, ["k"])) == 1 and hot_keys(counts.where("false"), ["k"]) == []
