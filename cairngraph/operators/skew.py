"""Joins and prefix sums whose largest task does not grow with the largest key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A side of at most this many bytes, as ``extent`` reckons them, may be sent to every executor.
BROADCAST_BYTES = 8 << 20
#: Rows of one key that one task may hold; with very many rows in all, as many as MOST_HOT keys leave.
ROWS_PER_SALT = 250_000
#: Keys that are treated as hot, at most: what is sent to every executor for them stays below this many rows.
MOST_HOT = 20_000


@dataclass(frozen=True)
class Extent:
    rows: int
    bytes: int


def extent(df: DataFrame) -> Extent:
    """Rows of ``df`` and about how many bytes they take in memory, by one aggregate; save ``df`` first."""
    each = F.lit(16 + 16 * len(df.columns))
    for c, kind in df.dtypes:
        if kind in ("string", "binary"):
            each = each + F.coalesce(F.octet_length(c), F.lit(0))
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(each), F.lit(0))).first()
    return Extent(n, int(size))


def salts_for(rows: int, rows_per_salt: int = ROWS_PER_SALT) -> int:
    """How many parts a key must be cut into if it held every row."""
    return max(1, -(-rows // rows_per_salt))


def hot_keys(counts: DataFrame, on: list[str], rows: int | None = None) -> list[int]:
    """Hashes of the keys that hold more rows than one task may, from their counts (``on``, n).

    With more than ROWS_PER_SALT * MOST_HOT rows the bound is a share of all: never more than MOST_HOT keys can be above it.
    """
    if rows is None:
        rows = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bound = max(ROWS_PER_SALT, -(-rows // MOST_HOT))
    if rows <= bound:
        return []
    return sorted({r[0] for r in counts.where(F.col("n") > bound).select(F.xxhash64(*on)).toLocalIterator()})


def split_join(big: DataFrame, small: DataFrame, on: list[str], how: str, hot: list[int]) -> DataFrame:
    """Join in two parts: rows of ``big`` with a hot key meet the few rows of ``small`` that have one where they are, the rest are exchanged.

    ``small`` has one row for a key, or a few; so at most MOST_HOT times that many rows are sent to the
    executors, and nothing is copied for the other keys. ``how`` is inner, left, left_semi or left_anti.
    """
    if not hot:
        return big.join(small, on, how)
    marks = F.broadcast(big.sparkSession.createDataFrame([(h,) for h in hot], "_hot long"))
    tag = lambda d, kind: d.withColumn("_hot", F.xxhash64(*on)).join(marks, "_hot", kind).drop("_hot")
    many, rest = tag(big, "left_semi"), tag(big, "left_anti")
    return rest.join(small, on, how).unionByName(many.join(F.broadcast(tag(small, "left_semi")), on, how))


def sized_join(big: DataFrame, small: DataFrame, on: list[str], how: str, size: Extent | None, counts: DataFrame | None = None, big_rows: int | None = None, limit: int | None = None) -> DataFrame:
    """Join ``big``, whose keys may be skewed, with ``small``, which has one row for a key or a few.

    Up to ``limit`` bytes, measured before (``size``), the small side is broadcast. Beyond that the keys
    of ``big`` are counted, if ``counts`` (``on``, n) does not say how often each occurs, and the hot ones
    are split off. ``big_rows`` saves that where it is known that there are few.
    """
    if size is not None and size.bytes <= (BROADCAST_BYTES if limit is None else limit):
        return big.join(F.broadcast(small), on, how)
    if big_rows is not None and big_rows <= ROWS_PER_SALT:
        return big.join(small, on, how)
    if counts is None:
        counts = big.groupBy(*on).agg(F.count("*").alias("n"))
    return split_join(big, small, on, how, hot_keys(counts, on, big_rows))


def salted_prefix(df: DataFrame, group: str, order: str, value: Column, rows: int, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Adds ``prefix``: the sum of ``value`` over the group's rows before this one, and ``place``: how many.

    The order within a group is (salt, ``order``), the salt a hash of ``order``; ``order`` is unique
    within its group. A group's rows are summed within their salts, then the few sums of the salts.
    """
    salts = salts_for(rows, rows_per_salt)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    cut = df.withColumn("_value", value.cast("long")).withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(salts)))
    within = Window.partitionBy(group, "_salt").orderBy(order)
    cut = cut.withColumn("_p", F.coalesce(F.sum("_value").over(before(within)), F.lit(0))).withColumn("_c", F.row_number().over(within) - 1)
    if salts == 1:
        return cut.withColumnRenamed("_p", "prefix").withColumn("place", F.col("_c").cast("long")).drop("_value", "_salt", "_c")
    over = Window.partitionBy(group).orderBy("_salt")
    sums = cut.groupBy(group, "_salt").agg(F.sum("_value").alias("_sv"), F.count("*").alias("_sc"))
    sums = sums.select(group, "_salt", F.coalesce(F.sum("_sv").over(before(over)), F.lit(0)).alias("_bp"), F.coalesce(F.sum("_sc").over(before(over)), F.lit(0)).alias("_bc"))
    out = cut.join(sums, [group, "_salt"])
    return out.withColumn("prefix", F.col("_p") + F.col("_bp")).withColumn("place", F.col("_c") + F.col("_bc")).drop("_value", "_salt", "_p", "_c", "_bp", "_bc")


def running_max(df: DataFrame, group: str, order: list[str], value: str, save, parts: int) -> DataFrame:
    """Adds ``running``: the largest ``value`` of the group's rows up to and with this one in ``order``.

    The rows are range-partitioned by (group, order), which cuts a large group where it is long.
    Each part is scanned by itself; the parts' maxima, at most one row for each part and group in
    it, are then carried over. ``save`` materialises the parts, so their bounds cannot move.
    """
    cut = save(df.repartitionByRange(parts, group, *order).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    scanned = cut.withColumn("_in", F.max(value).over(within))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = cut.groupBy(group, "_part").agg(F.max(value).alias("_m")).select(group, "_part", F.max("_m").over(before).alias("_carry"))
    out = scanned.join(carry, [group, "_part"])
    return out.withColumn("running", F.greatest("_in", "_carry")).drop("_part", "_in", "_carry")
