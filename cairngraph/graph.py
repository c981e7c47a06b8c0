"""The clean graph: living nodes and unique edges, materialised once for each state of a folder's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairngraph.operators.skew import hot_keys, split_join
from cairngraph.schema import EDGE_COLUMNS, EXTERNAL_PATH, NODE_COLUMNS
from cairngraph.sources.tables import table, unique_edges
from cairngraph.workspace import Workspace, version


def living_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each id: its last, if that is not deleted. Rows without id are left out; a null time is earliest."""
    last = nodes.where("id is not null").groupBy("id").agg(F.max(F.struct("ingested_at", "deleted_at", *NODE_COLUMNS)).alias("n"))
    return last.select("id", "n.*").where("deleted_at is null").drop("deleted_at")


class Graph:
    """nodes (id, the node columns, ingested_at) and edges (id, ingested_at, source, target, type, the edge columns)."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, work: Workspace):
        self.nodes, self.edges, self.work = nodes, edges, work
        self._hot: dict[str, list[int]] = {}

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame, work: Workspace) -> Graph:
        return cls(work.save(living_nodes(nodes)), work.save(unique_edges(edges, *EDGE_COLUMNS)), work)

    _loaded: dict = {}

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Graph:
        """The clean graph of a folder; kept until the files of its tables change."""
        key = (spark.sparkContext.applicationId, folder)
        state = tuple(version(spark, f"{folder}/{t}.parquet") for t in ("nodes", "edges"))
        held = cls._loaded.get(key)
        if held is None or held[0] != state:
            held = cls._loaded[key] = (state, cls.of(table(spark, folder, "nodes"), table(spark, folder, "edges"), Workspace(spark, "graph")))
        return held[1]

    def hot(self, end: str) -> list[int]:
        """Hashes of the ids that very many edges have as ``end`` (source or target), counted once."""
        if end not in self._hot:
            self._hot[end] = hot_keys(self.edges.groupBy(end).agg(F.count("*").alias("n")), [end])
        return self._hot[end]

    def meet(self, edges: DataFrame, side: DataFrame, end: str, how: str = "inner") -> DataFrame:
        """Edges joined on ``end`` with ``side``, which has one row for an id; a hub's edges stay where they are."""
        return split_join(edges, side, [end], how, self.hot(end))

    def typed(self, *types: str) -> DataFrame:
        return self.edges.where(F.col("type").isin(*types))

    def internal(self, *types: str) -> DataFrame:
        """Nodes of the code itself."""
        rows = self.nodes.where((F.col("namespace") == "INTERNAL") & (F.col("file_path") != EXTERNAL_PATH))
        return rows.where(F.col("type").isin(*types)) if types else rows
