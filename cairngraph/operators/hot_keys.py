"""A result for every pair of type and target, a few of which hold most edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairngraph.operators.selection import distinct_per_key, grouped_quantiles
from cairngraph.sources.tables import unique_edges
from cairngraph.workspace import Workspace

PROBS = {"weight_min": 0.0, "weight_p50": 0.5, "weight_p90": 0.9, "weight_max": 1.0}
PAIR = ["type", "target"]


def pair_profile(edges: DataFrame, work: Workspace, callers: bool = True) -> DataFrame:
    """type, target, n_edges, exact quantiles of weight and, with ``callers``, n_callers and n_files.

    An edge counts once, as it first arrived. Null types and targets make pairs of their own; null
    weights, sources and files are not counted. No edges give no rows. Columns that edges has
    besides its own do not matter.
    """
    first = work.save(unique_edges(edges, "weight", "file_path").select(*PAIR, "source", "weight", "file_path"))
    out = grouped_quantiles(first, PAIR, "weight", PROBS, work).withColumnRenamed("n_rows", "n_edges").drop("n_values")
    if not callers:
        return out
    for value, name in (("source", "n_callers"), ("file_path", "n_files")):
        side = distinct_per_key(first, PAIR, value, name).select(*[F.col(k).alias(f"_{k}") for k in PAIR], name)
        out = out.join(side, F.col("type").eqNullSafe(F.col("_type")) & F.col("target").eqNullSafe(F.col("_target")), "left").drop("_type", "_target").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def hot_pairs(profile: DataFrame, share: float = 0.01) -> DataFrame:
    """The pairs of a profile that hold at least ``share`` of its edges."""
    total = profile.agg(F.coalesce(F.sum("n_edges"), F.lit(0)).alias("all_edges"))
    return profile.join(F.broadcast(total)).where(F.col("n_edges") >= F.lit(share) * F.col("all_edges")).drop("all_edges")
