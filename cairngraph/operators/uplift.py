"""Domains of nodes from globs, and what they make of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairngraph.functions.paths import matches_any
from cairngraph.graph import Graph
from cairngraph.operators.drift import domain_dependencies
from cairngraph.operators.traversal import propagate_labels

# The class a node type stands for.
CLASSES = {"FILE": "File", "MODULE": "Module", "CLASS": "Class", "FUNCTION": "Function", "METHOD": "Method", "VARIABLE": "Variable", "DATA_KEY": "DataKey"}


def ontology_classes(nodes: DataFrame) -> DataFrame:
    table = F.create_map(*[x for k, v in CLASSES.items() for x in (F.lit(k), F.lit(v))])
    return nodes.withColumn("ontology_class", F.coalesce("ontology_class", table[F.col("type")]))


def tagged(nodes: DataFrame, domains: dict[str, dict[str, list[str]]]) -> DataFrame:
    """id, label: internal nodes whose file or id matches a glob of a domain (``file_path_patterns``, ``fqn_patterns``)."""
    tags = [F.when(matches_any("file_path", d.get("file_path_patterns") or []) | matches_any("id", d.get("fqn_patterns") or []), F.lit(n)) for n, d in domains.items()]
    if not tags:
        return nodes.select("id", F.lit("").alias("label")).where("false")
    return nodes.where("namespace = 'INTERNAL'").select("id", F.explode(F.filter(F.array(*tags), lambda x: x.isNotNull())).alias("label"))


def uplift(g: Graph, domains: dict[str, dict[str, list[str]]]) -> tuple[DataFrame, DataFrame]:
    """Nodes with their domains, tagged and handed down, and the dependencies between domains."""
    own = g.nodes.select("id", F.explode("domains").alias("label"))
    labels = g.work.save(propagate_labels(g, own.unionByName(tagged(g.nodes, domains))))
    sets = labels.groupBy("id").agg(F.array_sort(F.collect_set("label")).alias("_d"))
    nodes = ontology_classes(g.nodes).join(sets, "id", "left").withColumn("domains", F.coalesce("_d", F.array().cast("array<string>"))).drop("_d")
    nodes = g.work.save(nodes)
    return nodes, domain_dependencies(nodes, g.typed("CALLS"))
