"""The tables of a graph directory, and their cleaned forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairngraph.functions.text import trimmed, upper_word


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def edge_ends(edges: DataFrame) -> DataFrame:
    """Edges with id, clean source, target and type and the time of arrival; rows as they came."""
    return edges.select("id", trimmed("source").alias("source"), trimmed("target").alias("target"), upper_word("type").alias("type"), "ingested_at")


def unique_edges(edges: DataFrame, *more: str) -> DataFrame:
    """One row for each id: the one that came first; of rows that came together, the least by its other columns.

    source, target and type are cleaned. ``more`` names further columns to keep. Rows without an
    id are no edges and are left out; a null time counts as later than any other.
    """
    kept = ["source", "target", "type", *more]
    clean = edges.where("id is not null").select("id", F.coalesce("ingested_at", F.lit("9999-12-31").cast("timestamp")).alias("ingested_at"), trimmed("source").alias("source"), trimmed("target").alias("target"), upper_word("type").alias("type"), *more)
    first = clean.groupBy("id").agg(F.min(F.struct("ingested_at", *kept)).alias("e"))
    return first.select("id", "e.*")
