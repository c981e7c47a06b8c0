"""The queries p6 to p8 over a graph directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairngraph.llm.mixing import held_out, mix
from cairngraph.llm.packing import container_list, pack_texts, packing_summary
from cairngraph.llm.sentences import sentences
from cairngraph.sources.tables import table
from cairngraph.workspace import Workspace


def p6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_texts(table(spark, folder, "documents"), table(spark, folder, "containers"), Workspace(spark, "p6"))


def p6_summary(spark: SparkSession, folder: str) -> DataFrame:
    return packing_summary(p6_packing(spark, folder), container_list(table(spark, folder, "containers")))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), Workspace(spark, "p7"))[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), Workspace(spark, "p7"))[1]


def p7_held_out(spark: SparkSession, folder: str) -> DataFrame:
    return held_out(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), Workspace(spark, "p7"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences(table(spark, folder, "documents"))


def p8_counts(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_units and covered characters of each document with any."""
    return p8_found(spark, folder).groupBy("doc_id").agg(F.count("*").alias("n_units"), F.sum(F.col("end_char") - F.col("start_char")).alias("n_covered"))


QUERIES = {f.__name__: f for f in (p6_packing, p6_summary, p7_mix, p7_shares, p7_held_out, p8_found, p8_counts)}
#: None of these can be said in SQL; tests hold them against their rules.
ORACLE: dict[str, str] = {}
