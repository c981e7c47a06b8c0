import math
import random
import struct

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cairngraph.operators.hot_keys import hot_pairs, pair_profile
from cairngraph.operators import skew
from cairngraph.operators.selection import grouped_quantiles, ordered_bits
from cairngraph.workspace import Workspace
from pyspark.sql import functions as F
from tests.helpers import EDGES, edge, edges, rows

PROBS = {"lo": 0.0, "mid": 0.5, "high": 0.9, "top": 1.0}


def brute(values):
    s = sorted(v for v in values if v is not None and not math.isnan(v))
    return [s[max(1, math.ceil(p * len(s))) - 1] if s else None for p in PROBS.values()]


def check(spark, work, data, **options):
    df = spark.createDataFrame(data, "k string, v double")
    got = {r["k"]: [r[n] for n in PROBS] for r in grouped_quantiles(df, ["k"], "v", PROBS, work, **options).collect()}
    keys = {k for k, _ in data}
    assert got == {k: brute([v for x, v in data if x == k]) for k in keys}


def test_skew_ties_nulls_and_magnitudes(spark, work):
    rng = random.Random(1)
    data = [("hot", rng.choice([1e-300, 1e300, -1e300, 0.0, 1.0, rng.random(), rng.gauss(0, 1e9)])) for _ in range(3000)]
    data += [("one", 5.0), ("same", 2.0), ("same", 2.0), (None, 1.0), (None, None), ("none", None), ("nan", float("nan")), ("inf", float("inf")), ("inf", float("-inf")), ("inf", 3.0)]
    check(spark, work, data, bins=8)


def test_asked_ranks_with_hot_keys_split_off(spark, work, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_SALT", 150)
    rng = random.Random(2)
    check(spark, work, [(rng.choice(["a", "a", "b", None]), rng.random()) for _ in range(400)], bins=4, broadcast_bytes=0)


def test_few_rounds_for_any_magnitudes(spark):
    values = [10.0**-k for k in range(20, 300)] * 2 + [-(10.0**-k) for k in range(1, 300)]
    work = Workspace(spark, "rounds")
    check(spark, work, [("k", v) for v in values])
    assert work.made <= 2 + 6


def test_bit_patterns_are_in_order(spark):
    rng = random.Random(6)
    powers = [2.0**k * f for k in range(-1074, 1024, 7) for f in (1, 1 - 2**-53, 1 + 2**-52, -1)]
    values = [v for v in (struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(2000)) if v == v] + powers + [0.0, -0.0, math.inf, -math.inf, 5e-324, 1.7976931348623157e308]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", ordered_bits(F.col("v"))).collect()
    assert all(b == struct.unpack("<q", struct.pack("<d", abs(v)))[0] * (-1 if v < 0 else 1) for v, b in got)


def test_empty(spark, work):
    assert grouped_quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", PROBS, work).count() == 0


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.floats(allow_nan=False, allow_infinity=False))), min_size=1, max_size=30))
def test_any_values(spark, work, data):
    check(spark, work, data, bins=3)


def test_pairs_are_cleaned_and_counted_once(spark, work):
    e = edges(spark, [edge("1", "a", "t", "CALLS", 2.0, 1, "f"), edge("1", "a", "t", "calls", 9.0, 3, "f"), edge("2", "a ", " t", " Calls", 4.0, 1, "g"), edge("3", "b", "t", None, None), edge(None, "b", "t")])
    got = {(r["type"], r["target"]): r for r in pair_profile(e.withColumn("v", e["weight"]).withColumn("k0", e["id"]), work).collect()}
    assert set(got) == {("CALLS", "t"), (None, "t")}
    r = got["CALLS", "t"]
    assert (r["n_edges"], r["weight_min"], r["weight_p50"], r["weight_max"], r["n_callers"], r["n_files"]) == (2, 2.0, 2.0, 4.0, 1, 2)
    assert got[None, "t"]["weight_p50"] is None


def test_hot_pairs_share(spark, work):
    e = edges(spark, [edge(str(i), f"s{i}", "hot") for i in range(150)] + [edge(f"c{i}", "s", f"t{i}") for i in range(50)])
    assert rows(hot_pairs(pair_profile(e, work)).select("target", "n_edges")) == [("hot", 150)]
    assert hot_pairs(pair_profile(spark.createDataFrame([], EDGES), work)).count() == 0
