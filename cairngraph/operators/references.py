"""Ends of edges that name no node living at the edge's time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairngraph.functions.text import is_name, trimmed
from cairngraph.operators.skew import extent, running_max, sized_join
from cairngraph.workspace import Workspace

#: Rows of history that one part of the scan for deletions holds.
ROWS_PER_PART = 1_000_000
FOREVER = "timestamp'9999-12-31 00:00:00'"


def references(edges: DataFrame) -> DataFrame:
    """edge_id, side, key and t of each end that is a reference: not null and not an unresolved name. Rows as they came."""
    ends = F.array(*[F.struct(F.lit(s).alias("side"), trimmed(s).alias("key")) for s in ("source", "target")])
    refs = edges.select(F.col("id").alias("edge_id"), F.col("ingested_at").alias("t"), F.explode(ends).alias("e"))
    return refs.select("edge_id", "e.side", "e.key", "t").where(F.col("edge_id").isNotNull() & F.col("t").isNotNull() & F.col("key").isNotNull() & ~is_name("key"))


def orphan_references(edges: DataFrame, nodes: DataFrame, work: Workspace, broadcast_bytes: int | None = None) -> DataFrame:
    """edge_id, side, t, reason of each reference without a node at the edge's time t, its earliest arrival.

    ``missing``: no node row has the key; ``late``: the first one came after t; ``deleted``: none of
    those that had come by t was still there. A null end is no reference; an empty one is a key like
    any other. Node rows without id or time are no nodes; nor are edge rows without them edges.
    With no nodes every reference is missing.

    The distinct keys are anti-joined with the nodes' ids. A key whose first node that was never
    deleted came before the key was first used can have no orphan. What remains, the suspects, is
    joined back to the references; edges need not be made unique before, as all rows of one edge
    have the same ends. Suspects of more than ``broadcast_bytes`` are exchanged, those of hot keys, counted on the way, are not.
    """
    refs = references(edges)
    keys = work.save(refs.groupBy("key").agg(F.min("t").alias("first_use"), F.count("*").alias("n")))
    living = nodes.where("id is not null and ingested_at is not null")
    known = living.groupBy("id").agg(F.min("ingested_at").alias("first"), F.min(F.when(F.col("deleted_at").isNull(), F.col("ingested_at"))).alias("kept_from"), F.count("*").alias("n_told"))
    missing = keys.join(known, keys["key"] == known["id"], "left_anti").select("key", F.lit(None).cast("timestamp").alias("first"), F.lit(None).cast("timestamp").alias("kept_from"), "n", F.lit(0).cast("long").alias("n_told"))
    unsure = keys.join(known, keys["key"] == known["id"]).where("kept_from is null or kept_from > first_use").select("key", "first", "kept_from", "n", "n_told")
    suspects = work.save(missing.unionByName(unsure))
    names = suspects.select("key", "first", "kept_from")
    counts = suspects.select("key", "n")
    hits = sized_join(refs, names, ["key"], "inner", extent(names), counts, limit=broadcast_bytes).groupBy("edge_id", "side", "key", "first", "kept_from").agg(F.min("t").alias("t"))
    hits = work.save(hits.where("kept_from is null or t < kept_from"))
    sure = hits.where("first is null or t < first").select("edge_id", "side", "t", F.when(F.col("first").isNull(), "missing").otherwise("late").alias("reason"))
    # Between the first node and the first one that stays, each time needs the node's history.
    between = hits.where("first <= t")
    asked = between.select("key", F.col("t").alias("at")).distinct()
    known_keys = suspects.where("first is not null")
    told = living.select(F.col("id").alias("key"), F.col("ingested_at").alias("at"), F.expr(f"coalesce(deleted_at, {FOREVER})").alias("until"))
    told = sized_join(told, known_keys.select("key"), ["key"], "left_semi", extent(known_keys.select("key")), known_keys.select("key", F.col("n_told").alias("n")), limit=broadcast_bytes).groupBy("key", "at").agg(F.max("until").alias("until"))
    history = told.withColumn("kind", F.lit(0)).unionByName(asked.withColumn("kind", F.lit(1)).withColumn("until", F.lit(None).cast("timestamp")))
    history = work.save(history)
    parts = max(8, -(-history.count() // ROWS_PER_PART))
    gone = running_max(history, "key", ["at", "kind"], "until", work.save, parts).where("kind = 1 and running <= at").select("key", F.col("at").alias("t"))
    deleted = between.join(gone, ["key", "t"], "left_semi").select("edge_id", "side", "t", F.lit("deleted").alias("reason"))
    return sure.unionByName(deleted)


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """side, period (month of the edge's time, as YYYY-MM), reason and n_refs."""
    return orphans.groupBy("side", F.date_format("t", "yyyy-MM").alias("period"), "reason").agg(F.count("*").alias("n_refs"))
