"""Censuses, lookups, searches and merges over the stored graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairngraph.functions.text import under
from cairngraph.graph import Graph
from cairngraph.schema import EXTERNAL_PATH, KEY_TYPES, RAW_CALL


def _with_target(g: Graph, edges: DataFrame, *columns: str) -> DataFrame:
    return g.meet(edges, g.nodes.select(F.col("id").alias("target"), *[F.col(c).alias(f"target_{c}") for c in columns]), "target", "left")


def unresolved() -> Column:
    """After a join with target_namespace: a target without node, of unknown origin, or a raw call."""
    return F.col("target_namespace").isNull() | (F.col("target_namespace") == "UNKNOWN") | F.col("target").startswith(RAW_CALL)


def edge_stats(g: Graph) -> DataFrame:
    """One row: total, resolved, stdlib, external, unresolved, unresolved_ratio; dispatch and key edges do not count."""
    e = _with_target(g, g.edges.where(~F.col("type").isin("DISPATCHES", *KEY_TYPES)).select("target"), "namespace")
    space = lambda n: F.count(F.when(F.col("target_namespace") == n, 1))
    out = e.agg(F.count("*").alias("total"), space("INTERNAL").alias("resolved"), space("STDLIB").alias("stdlib"), space("EXTERNAL").alias("external"), F.count(F.when(unresolved(), 1)).alias("unresolved"))
    return out.withColumn("unresolved_ratio", F.when(F.col("total") > 0, F.col("unresolved") / F.col("total")).otherwise(0.0))


def resolution_by_source(g: Graph, depth: int = 1) -> DataFrame:
    """package (first ``depth`` parts of the source), total, unresolved."""
    e = _with_target(g, g.edges.where(~F.col("type").isin("DISPATCHES", *KEY_TYPES)).select("source", "target"), "namespace")
    return e.groupBy(F.substring_index("source", ".", depth).alias("package")).agg(F.count("*").alias("total"), F.count(F.when(unresolved(), 1)).alias("unresolved"))


def resolution_of(g: Graph, of_source: Column) -> DataFrame:
    """One row: total, unresolved of the edges whose source passes; dispatch and key edges do not count."""
    e = g.edges.where(~F.col("type").isin("DISPATCHES", *KEY_TYPES) & of_source)
    return _with_target(g, e.select("target"), "namespace").agg(F.count("*").alias("total"), F.count(F.when(unresolved(), 1)).alias("unresolved"))


def top_unresolved(g: Graph, limit: int = 10) -> DataFrame:
    e = _with_target(g, g.edges.where(~F.col("type").isin(*KEY_TYPES)).select("target"), "namespace")
    counts = e.where("target_namespace is null or target_namespace = 'UNKNOWN'").groupBy("target").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "target").limit(limit)


def symbol_census(g: Graph) -> DataFrame:
    return g.internal().where("type <> 'FILE'").groupBy("type").agg(F.count("*").alias("n"))


def package_census(g: Graph, depth: int = 2) -> DataFrame:
    """prefix, n_production, n_test; the prefix never holds a symbol's own name."""
    parts = F.split("id", "[.]")
    prefix = F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(max(depth, 1)), F.greatest(F.size(parts) - 1, F.lit(1)))), ".")
    return g.internal().where("type <> 'FILE'").groupBy(prefix.alias("prefix")).agg(F.count(F.when(~F.col("is_test"), 1)).alias("n_production"), F.count(F.when(F.col("is_test"), 1)).alias("n_test"))


def symbol_search(g: Graph, text: str, kinds: tuple[str, ...] = (), prefix: str | None = None, limit: int = 20) -> DataFrame:
    """Nodes whose name holds ``text``: the same name first, then names that begin with it; shorter ids first. A blank text finds none."""
    rows = g.nodes.where(F.lit(bool(text.strip())) & F.contains(F.lower("name"), F.lit(text.lower())))
    rows = rows.where(F.col("type").isin(*kinds)) if kinds else rows
    rows = rows.where(under("id", prefix)) if prefix else rows
    rank = F.when(F.col("name") == text, 0).when(F.lower("name").startswith(text.lower()), 1).otherwise(2)
    return rows.select("id", "type", "name", rank.alias("rank")).orderBy("rank", F.length("id"), "id").limit(limit)


def suffix_search(g: Graph, suffix: str, limit: int = 20) -> DataFrame:
    """Ids that end with ``suffix`` at a dot."""
    return g.nodes.where(F.col("id").endswith("." + suffix)).select("id", "type").orderBy("id").limit(limit)


def files_under(g: Graph, prefix: str) -> DataFrame:
    return g.nodes.where(F.col("id").startswith(prefix + ".") & (F.col("type") == "FILE") & (F.col("namespace") == "INTERNAL")).select("id", "file_path")


def nodes_of_files(g: Graph) -> DataFrame:
    """file_path, n_nodes, n_symbols, last_line of each file."""
    return g.internal().groupBy("file_path").agg(F.count("*").alias("n_nodes"), F.count(F.when(F.col("type") != "FILE", 1)).alias("n_symbols"), F.max("end_line").alias("last_line"))


def build_excluded_files(g: Graph) -> DataFrame:
    reason = F.get_json_object("metadata", "$.build_excluded")
    return g.nodes.where((F.col("type") == "FILE") & reason.isNotNull()).select("file_path", reason.alias("reason"))


def referenced_targets(g: Graph, production_only: bool = True) -> DataFrame:
    """Distinct targets of edges whose source is a node, by default not of a test."""
    sources = g.nodes.where(~F.col("is_test")) if production_only else g.nodes
    return g.meet(g.edges.select("source", "target"), sources.select(F.col("id").alias("source")), "source", "left_semi").select("target").distinct()


def unknown_calls(g: Graph) -> DataFrame:
    """name, n_calls of nodes of unknown origin that are called."""
    t = g.nodes.where("namespace = 'UNKNOWN'").select(F.col("id").alias("target"), "name")
    return g.meet(g.typed("CALLS").select("target"), t, "target").groupBy("name").agg(F.count("*").alias("n_calls"))


def unresolved_sites(g: Graph, per_name: int = 3) -> DataFrame:
    """name, nth, source, line_number: where each unresolved call stands, the first few by line."""
    e = _with_target(g, g.typed("CALLS").select("id", "source", "target", "line_number"), "namespace").where(unresolved())
    order = Window.partitionBy("name").orderBy(F.col("line_number").isNull(), "source", "line_number", "id")
    # Before the window, what one name needs of each source is few rows: hot names are cut down where they are read.
    near = Window.partitionBy("name", "source").orderBy(F.col("line_number").isNull(), "line_number", "id")
    few = e.withColumn("name", F.col("target")).withColumn("k", F.row_number().over(near)).where(F.col("k") <= per_name)
    return few.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_name).select("name", "nth", "source", "line_number")


def distinct_links(g: Graph) -> DataFrame:
    """source, type, target, confidence: parallel edges as one, with the greatest confidence."""
    return g.edges.groupBy("source", "type", "target").agg(F.max("confidence").alias("confidence"))


def upsert(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by ``order``; rows without key are left out."""
    rest = [c for c in rows.columns if c != key and c not in order]
    last = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("r"))
    return last.select(key, *[F.col(f"r.{c}").alias(c) for c in rows.columns if c != key])


def ranked_virtual_upsert(nodes: DataFrame) -> DataFrame:
    """Boundary nodes: a known origin beats an unknown one, then the least language, then the latest row."""
    virtual = nodes.where(F.col("file_path") == EXTERNAL_PATH)
    rank = F.struct((F.col("namespace") == "UNKNOWN").alias("unknown"), F.col("language").alias("language"), (-F.unix_micros("ingested_at")).alias("age"), F.col("namespace").alias("namespace"), F.col("name").alias("name"))
    return virtual.groupBy("id").agg(F.min(rank).alias("r")).select("id", "r.namespace", "r.language", "r.name")


def without_files(g: Graph, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges left when ``files`` (file_path) are deleted: edges go with their source node or their own file."""
    gone = files.select("file_path").distinct()
    nodes = g.nodes.join(gone, "file_path", "left_anti")
    dead = g.nodes.join(gone, "file_path", "left_semi").select(F.col("id").alias("source"))
    return nodes, g.meet(g.edges, dead, "source", "left_anti").join(gone, "file_path", "left_anti")


def incremental_nodes(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Node rows after a batch: the batch replaces all rows of the ids it has."""
    return old.join(batch.select("id").distinct(), "id", "left_anti").unionByName(batch)


def file_signatures(nodes: DataFrame) -> DataFrame:
    """file_path, signature: a hash of what other files can see of it."""
    seen = F.concat_ws("|", "id", "type", F.coalesce("metadata", F.lit("")))
    return nodes.where(F.col("file_path") != EXTERNAL_PATH).groupBy("file_path").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(seen)), "\n"), 256).alias("signature"))


def signature_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """file_path, change of files whose signature is new, gone or different."""
    o, n = old.withColumnRenamed("signature", "was"), new.withColumnRenamed("signature", "now")
    both = o.join(n, "file_path", "full").where("was is null or now is null or was <> now")
    return both.select("file_path", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed").alias("change"))


def freshness(log: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: status FRESH, STALE or UNKNOWN (no run succeeded), n_stale: files seen since the last run that did."""
    mark = runs.where("status = 'ok'").agg(F.max("started_at").alias("mark"))
    seen = log.groupBy("key").agg(F.max("seen_at").alias("seen"))
    out = seen.join(F.broadcast(mark)).agg(F.count(F.when(F.col("seen") > F.col("mark"), 1)).alias("n_stale"), F.max("mark").alias("mark"))
    return out.select(F.when(F.col("mark").isNull(), "UNKNOWN").when(F.col("n_stale") > 0, "STALE").otherwise("FRESH").alias("status"), "n_stale")
