"""Graphs written as JSON, text trees and diagrams."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """One JSON object a line, nodes and edges in folders of their own."""
    nodes.write.mode("overwrite").json(f"{folder}/nodes")
    edges.write.mode("overwrite").json(f"{folder}/edges")


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, id, body: each node and each distinct link as a JSON text."""
    link = edges.groupBy("source", "type", "target").agg(F.max("confidence").alias("confidence"))
    n = nodes.select(F.lit("node").alias("kind"), "id", F.to_json(F.struct("id", "type", "name", "file_path", "start_line", "end_line")).alias("body"))
    return n.unionByName(link.select(F.lit("edge").alias("kind"), F.concat_ws(" ", "source", "type", "target").alias("id"), F.to_json(F.struct("source", "type", "target", "confidence")).alias("body")))


def text_tree(root: str, links: DataFrame, limit: int = 500) -> str:
    """A small answer as an indented tree; an id met again is marked and not followed. More links than ``limit`` are refused."""
    rows = links.select("source", "target").distinct().orderBy("source", "target").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} links")
    below: dict[str, list[str]] = {}
    for r in rows:
        below.setdefault(r["source"], []).append(r["target"])
    out, seen, todo = [], set(), [(root, 0)]
    while todo:
        x, depth = todo.pop()
        out.append("  " * depth + x + (" ↪" if x in seen and below.get(x) else ""))
        if x not in seen:
            seen.add(x)
            todo.extend((y, depth + 1) for y in reversed(below.get(x, [])))
    return "\n".join(out)


def mermaid(links: DataFrame, limit: int = 500) -> str:
    """A small answer as a Mermaid flow chart."""
    rows = links.select("source", "type", "target").distinct().orderBy("source", "type", "target").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} links")
    name = {x: f"n{k}" for k, x in enumerate(sorted({y for r in rows for y in (r["source"], r["target"])}))}
    safe = lambda x: re.sub(r'["\[\]]', "'", x)
    return "\n".join(["flowchart LR", *(f'  {k}["{safe(x)}"]' for x, k in name.items()), *(f"  {name[r['source']]} -->|{r['type']}| {name[r['target']]}" for r in rows)])
