"""Data keys (``key:<namespace>|<path>``) and what a change of lines touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairngraph.functions.text import clean_path
from cairngraph.graph import Graph
from cairngraph.schema import KEY_TYPES

MAX_FILES = 8
# Parts of paths that say nothing of the data.
COMMON_PARTS = ("id", "name", "type", "data", "value", "key", "items", "result")
#: Lines of one bucket of the span join.
SPAN_BUCKET = 64


def key_sites(g: Graph) -> DataFrame:
    """key, namespace, path, source, file_path, type of each edge that reads, writes or declares a key."""
    e = g.typed(*KEY_TYPES).where(F.col("target").startswith("key:")).select(F.col("target").alias("key"), "source", "file_path", "type")
    body = F.substr("key", F.lit(5))
    return e.select("key", F.substring_index(body, "|", 1).alias("namespace"), F.substr(body, F.length(F.substring_index(body, "|", 1)) + 2).alias("path"), "source", "file_path", "type")


def key_matches(sites: DataFrame) -> DataFrame:
    """a, b: pairs of different keys that can name the same data: same path, same namespace or either none.

    Keys are joined on path and namespace; only unscoped ones meet all namespaces of their path.
    """
    keys = sites.select("key", "namespace", "path").distinct()
    bare = keys.where("namespace = ''").select("path", F.col("key").alias("bare"))
    scoped = keys.where("namespace <> ''").select("path", F.col("key").alias("scoped"))
    return bare.join(scoped, "path").select(F.least("bare", "scoped").alias("a"), F.greatest("bare", "scoped").alias("b"))


def key_specificity(sites: DataFrame) -> DataFrame:
    """key, n_files, specificity (parts of the path, one more if scoped, less log2 of its files), dropped (too common to list)."""
    rows = sites.groupBy("key", "namespace", "path").agg(F.countDistinct("file_path").alias("n_files"))
    scoped = F.col("namespace") != ""
    score = F.size(F.split("path", "[.]")) + scoped.cast("int") - F.log2(F.greatest("n_files", F.lit(1)))
    common = F.forall(F.split("path", "[.]"), lambda part: part.isin(*COMMON_PARTS))
    return rows.select("key", "n_files", score.alias("specificity"), (~scoped & (common | (F.col("n_files") > MAX_FILES))).alias("dropped"))


def keys_inside(sites: DataFrame) -> DataFrame:
    """outer_key, inner_key: a key and another of its namespace whose path lies below, by joining paths with their heads."""
    keys = sites.select("key", "namespace", "path").distinct()
    parts = F.split("path", "[.]")
    heads = keys.where(F.size(parts) > 1).select(F.col("key").alias("inner_key"), "namespace", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "."))).alias("path"))
    return keys.join(heads, ["namespace", "path"]).select(F.col("key").alias("outer_key"), "inner_key")


def span_join(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """id, file_path, line: nodes whose span holds a changed line (file_path, line).

    Spans are cut into buckets of lines, so a long file's nodes and lines meet only where they are near.
    """
    spans = nodes.where("start_line <= end_line").select("id", clean_path("file_path").alias("file_path"), "start_line", "end_line", F.explode(F.sequence(F.floor(F.col("start_line") / SPAN_BUCKET), F.floor(F.col("end_line") / SPAN_BUCKET))).alias("bucket"))
    changed = lines.select(clean_path("file_path").alias("file_path"), "line", F.floor(F.col("line") / SPAN_BUCKET).alias("bucket")).distinct()
    return spans.join(changed, ["file_path", "bucket"]).where("line between start_line and end_line").select("id", "file_path", "line")


def changed_callers(g: Graph, changed: DataFrame) -> DataFrame:
    """changed, site, n_calls: who calls a changed node, itself left out."""
    c = changed.select(F.col("id").alias("target")).distinct()
    e = g.typed("CALLS").join(c, "target", "left_semi").where("source <> target")
    return e.groupBy(F.col("target").alias("changed"), F.col("source").alias("site")).agg(F.count("*").alias("n_calls"))


def hunks(diff: str) -> list[tuple[str, int, int]]:
    """(file, first, last) of the new side's spans in a unified diff; a deletion has the line it came after."""
    import re

    out, path = [], ""
    for line in diff.splitlines():
        if line.startswith("+++ "):
            name = line[4:].split("\t")[0]
            path = "" if name == "/dev/null" else re.sub(r"^b/", "", name)
        elif m := re.match(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", line):
            start, length = int(m[1]), int(m[2] or 1)
            if path:
                out.append((path, start, start + max(length, 1) - 1))
    return out
