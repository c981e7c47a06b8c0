"""Exact statistics for each key, whatever share of the rows a key holds.

Quantiles come from value histograms that are refined until every wanted rank has one value left:
counts, minima and maxima of bins merge on the map side, so a hot key costs each task a few bins and
its values are never brought together. Bins are equally wide in one round and equally long stretches of
the doubles' bit patterns in the next: the latter leave a 128th of the at most 2^63 patterns between two
bounds each time, so ten of them end any search, and values that lie close take three rounds or so.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairngraph.operators.skew import extent, sized_join
from cairngraph.workspace import Workspace

BINS = 128
LARGEST = 1.7976931348623157e308
NO_KEY = "\x00null"


def _linear(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin of ``v`` among equally wide ones; halved first, so that hi - lo cannot overflow. Infinities count as the largest doubles."""
    v, lo, hi = (F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), x)) for x in (v, lo, hi))
    share = (v / 2 - lo / 2) / (hi / 2 - lo / 2)
    return F.when(lo >= hi, F.lit(0)).otherwise(F.least(F.lit(bins - 1), F.floor(share * bins).cast("int")))


def ordered_bits(v: Column) -> Column:
    """Longs in the order of the doubles: the bit pattern of the absolute value, with the sign. Null for NaN.

    The exponent is that of log2, put right where rounding led it astray; all other steps are exact.
    """
    x = F.abs(v)
    two = lambda e: F.pow(F.lit(2.0), e)
    guess = F.least(F.lit(1023.0), F.greatest(F.lit(-1022.0), F.floor(F.log2(x)).cast("double")))
    e = F.when(two(guess) > x, guess - 1).when((guess < 1023) & (x / two(guess) >= 2), guess + 1).otherwise(guess)
    normal = (e + 1023).cast("long") * F.lit(1 << 52) + ((x / two(e) - 1) * float(1 << 52)).cast("long")
    small = (x * 2.0**537 * 2.0**537).cast("long")
    bits = F.when(x == float("inf"), F.lit(2047 << 52)).when(x < 2.0**-1022, small).otherwise(normal)
    return F.when(~F.isnan(v), F.when(v < 0, -bits).otherwise(bits))


def _patterns(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin by bit patterns; bounds of different signs are cut at zero."""
    b, low, high = ordered_bits(v), ordered_bits(lo), ordered_bits(hi)
    within = F.least(F.lit(bins - 1), F.floor((b - low) / (high - low) * bins).cast("int"))
    return F.when((lo < 0) & (hi > 0), F.when(v < 0, 0).when(v == 0, 1).otherwise(2)).otherwise(within)


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], work: Workspace, bins: int = BINS, broadcast_bytes: int | None = None) -> DataFrame:
    """For each key the number of rows, of values, and exact quantiles of ``value``.

    The quantile at p is the smallest value with at least ceil(p * n) of the n values at or below
    it; p = 0 gives the minimum. Returns keys, n_rows, n_values and one double for each name in
    ``probs``. Null keys form groups like any other. Null and NaN values count in n_rows only; a
    key without values has null quantiles. An empty table gives an empty result. Infinities are
    values. ``df`` is read once for each round: save it first if it is costly.
    """
    v = F.col(value).cast("double")
    rows = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.when(~F.isnan(v), v).alias("v"))
    ks = [f"k{i}" for i in range(len(keys))]
    span = rows.where("abs(v) < double('Infinity')").agg(F.min("v"), F.max("v")).first()
    lo, hi = (F.lit(float(x or 0.0)) for x in span)
    bin_ = F.when(F.col("v").isNull(), F.lit(-1)).when(F.col("v") < lo, F.lit(0)).when(F.col("v") > hi, F.lit(bins - 1)).otherwise(_linear(F.col("v"), lo, hi, bins))
    merged = [F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")]
    hist = work.save(rows.groupBy(*ks, bin_.alias("b")).agg(*merged))
    sizes = hist.groupBy(*ks).agg(F.sum("c").alias("n_rows"), F.sum(F.when(F.col("b") >= 0, F.col("c")).otherwise(0)).alias("n_values"))
    # A wanted rank: q is its number, below the count of values under the interval [lo, hi] it lies in.
    up_to = Window.partitionBy(*ks).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    over = hist.where("b >= 0").withColumn("below", F.coalesce(F.sum("c").over(up_to), F.lit(0)))
    over = over.withColumn("n", F.sum("c").over(Window.partitionBy(*ks)))
    wanted = F.array(*[F.struct(F.lit(i).alias("q"), F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n"))).cast("long").alias("rank")) for i, p in enumerate(probs.values())])
    found = over.withColumn("w", F.explode(wanted)).select(*ks, "w.q", "w.rank", "lo", "hi", "below", "c").where("rank > below and rank <= below + c").drop("c")
    state = work.save(found)
    done = [state.where("lo = hi")]
    todo = state.where("lo < hi")
    # Keys may be null, and a join needs them equal all the same.
    names = [F.coalesce(F.col(k).cast("string"), F.lit(NO_KEY)).alias(f"j_{k}") for k in ks]
    js = [f"j_{k}" for k in ks]
    held = sizes.select(*names, F.col("n_values").alias("n")).groupBy(*js).agg(F.sum("n").alias("n"))
    for turn in count():
        size = extent(todo.select(*ks, "lo", "hi"))
        if not size.rows:
            break
        asked = todo.select(*ks, *names, F.col("lo").alias("from"), F.col("hi").alias("to")).distinct()
        # Beyond the size of a broadcast, the few hot keys' intervals still are, so that no hot key's values are exchanged.
        inside = sized_join(rows.where("v is not null").select(*names, "v"), asked, js, "inner", size, held, limit=broadcast_bytes).where("v >= from and v <= to")
        cut = (_patterns if turn % 2 else _linear)(F.col("v"), F.col("from"), F.col("to"), bins)
        parts = inside.groupBy(*js, "from", "to", F.when(F.col("v") == F.col("from"), F.lit(-1)).when(F.col("v") == F.col("to"), F.lit(bins)).otherwise(cut).alias("b")).agg(*merged)
        up_to = Window.partitionBy(*js, "from", "to").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("passed", F.coalesce(F.sum("c").over(up_to), F.lit(0)))
        open_ = todo.select(*ks, *names, "q", "rank", F.col("lo").alias("from"), F.col("hi").alias("to"), "below")
        step = open_.join(parts, [*js, "from", "to"]).withColumn("below", F.col("below") + F.col("passed")).where("rank > below and rank <= below + c")
        state = work.save(step.select(*ks, "q", "rank", "lo", "hi", "below"))
        done.append(state.where("lo = hi"))
        todo = state.where("lo < hi")
    resolved = done[0]
    for d in done[1:]:
        resolved = resolved.unionByName(d)
    picks = resolved.groupBy(*ks).agg(*[F.max(F.when(F.col("q") == i, F.col("lo"))).alias(f"q{i}") for i in range(len(probs))])
    same = [sizes[k].eqNullSafe(picks[k]) for k in ks]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    out = sizes.join(picks, cond, "left")
    return out.select(*[sizes[k].alias(n) for k, n in zip(ks, keys)], "n_rows", "n_values", *[F.col(f"q{i}").alias(n) for i, n in enumerate(probs)])


def distinct_per_key(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Exact distinct non-null values for each key, counted in two steps: the first spreads a hot key by its values."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.lit(1).alias("_one")).groupBy(*keys).agg(F.count("*").alias(name))
