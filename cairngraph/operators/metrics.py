"""Metrics of the whole graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairngraph.graph import Graph
from cairngraph.operators.components import connected_components, strong_components
from cairngraph.operators.traversal import min_depths
from cairngraph.schema import EXTERNAL_PATH, HEALTH_TYPES, STRUCTURAL, USE_TYPES

#: Links of one bucket of PageRank, about.
LINKS_PER_BUCKET = 2_000_000


def _ends(g: Graph, edges: DataFrame, *columns: str) -> DataFrame:
    s = g.nodes.select(F.col("id").alias("source"), *[F.col(c).alias(f"source_{c}") for c in columns])
    t = g.nodes.select(F.col("id").alias("target"), *[F.col(c).alias(f"target_{c}") for c in columns])
    return g.meet(g.meet(edges, s, "source"), t, "target")


def node_coupling(g: Graph) -> DataFrame:
    """id, type, in_degree (calls from anywhere), out_degree (calls of internal code) of functions and methods; parallel calls count."""
    calls = g.typed("CALLS").select("source", "target")
    into = calls.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("in_degree"))
    out = g.meet(calls, g.internal().select(F.col("id").alias("target")), "target", "left_semi").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("out_degree"))
    rows = g.internal("FUNCTION", "METHOD").select("id", "type").join(into, "id", "left").join(out, "id", "left")
    return rows.na.fill(0, ["in_degree", "out_degree"])


def god_classes(g: Graph) -> DataFrame:
    """id, declares: members of each class."""
    classes = g.nodes.where("type = 'CLASS'").select(F.col("id").alias("source"))
    return g.meet(g.typed("DECLARES").select("source"), classes, "source", "left_semi").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("declares"))


def file_coupling(g: Graph) -> DataFrame:
    """id, file_path, afferent, efferent, instability (null for a file coupled to none)."""
    pairs = _ends(g, g.typed("IMPORTS", "CALLS").select("source", "target"), "file_path", "namespace")
    pairs = pairs.where("source_namespace = 'INTERNAL' and target_namespace = 'INTERNAL' and source_file_path <> target_file_path").where((F.col("source_file_path") != EXTERNAL_PATH) & (F.col("target_file_path") != EXTERNAL_PATH)).select("source_file_path", "target_file_path").distinct()
    ca = pairs.groupBy(F.col("target_file_path").alias("file_path")).agg(F.count("*").alias("afferent"))
    ce = pairs.groupBy(F.col("source_file_path").alias("file_path")).agg(F.count("*").alias("efferent"))
    rows = g.internal("FILE").select("id", "file_path").join(ca, "file_path", "left").join(ce, "file_path", "left").na.fill(0, ["afferent", "efferent"])
    both = F.col("afferent") + F.col("efferent")
    return rows.select("id", "file_path", "afferent", "efferent", F.when(both > 0, F.col("efferent") / both).alias("instability"))


def fan_counts(g: Graph) -> DataFrame:
    """id, fan_in, fan_out over calls, imports, references and uses, of every node."""
    e = g.typed(*HEALTH_TYPES).select("source", "target")
    into = e.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("fan_in"))
    out = e.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("fan_out"))
    return g.nodes.select("id").join(into, "id", "left").join(out, "id", "left").na.fill(0, ["fan_in", "fan_out"])


def _structure(g: Graph) -> DataFrame:
    return g.typed(*STRUCTURAL).select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct()


def structural_depth(g: Graph) -> DataFrame:
    """id, depth: least number of steps down from a file; 0 for what hangs below none. Every node."""
    files = g.nodes.where("type = 'FILE'").select("id")
    found = min_depths(_structure(g), files, g.work)
    return g.nodes.select("id").join(found, "id", "left").na.fill(0, ["depth"])


def import_cycles(g: Graph) -> DataFrame:
    """id, component, size: internal files and modules on a cycle of runtime imports; component is the least member."""
    files = g.nodes.where("namespace = 'INTERNAL' and type in ('FILE', 'MODULE')").select("id")
    e = g.typed("IMPORTS").where("not type_only").select(F.col("source").alias("src"), F.col("target").alias("dst")).where("src <> dst").distinct()
    e = e.join(files.withColumnRenamed("id", "src"), "src", "left_semi").join(files.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return strong_components(e, g.work)


def cycle_report(cycles: DataFrame) -> DataFrame:
    """focal, size, severity of each cycle."""
    return cycles.groupBy(F.col("component").alias("focal")).agg(F.count("*").alias("size")).withColumn("severity", F.least(F.lit(1.0), (F.col("size") - 1) / 4))


def health(g: Graph) -> DataFrame:
    """id, fan_in, fan_out, depth, in_cycle: whether the nearest file or module above lies on an import cycle."""
    roots = g.nodes.where("type in ('FILE', 'MODULE')").select("id")
    owners = min_depths(_structure(g), roots, g.work, owner=True)
    cyclic = import_cycles(g).select(F.col("id").alias("owner"), F.lit(True).alias("in_cycle"))
    return fan_counts(g).join(structural_depth(g), "id").join(owners.select("id", "owner"), "id", "left").withColumn("owner", F.coalesce("owner", "id")).join(cyclic, "owner", "left").select("id", "fan_in", "fan_out", "depth", F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"))


def pagerank(g: Graph, iterations: int = 20, damping: float = 0.85, exclude: Sequence[str] = ()) -> DataFrame:
    """id, rank over calls among internal functions, methods and classes; parallel calls count, dangling mass is spread evenly. Ids with a part in ``exclude`` are out."""
    kept = g.internal("FUNCTION", "METHOD", "CLASS").select("id")
    for part in exclude:
        kept = kept.where(~F.contains(F.concat(F.lit("."), "id", F.lit(".")), F.lit(f".{part}.")))
    nodes = g.work.save(kept)
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    calls = g.meet(g.typed("CALLS").select("source", "target"), nodes.withColumnRenamed("id", "source"), "source", "left_semi")
    inside = g.meet(calls, nodes.withColumnRenamed("id", "target"), "target", "left_semi")
    links = inside.groupBy("source", "target").agg(F.count("*").alias("m"))
    degree = inside.groupBy("source").agg(F.count("*").alias("degree"))
    # The links lie in buckets of their source from here on: a round exchanges ranks and flows, never the links.
    shares = links.join(degree, "source").select("source", "target", (F.col("m") / F.col("degree")).alias("share"))
    links = g.work.save_bucketed(shares, "source", max(1, -(-g.edges.count() // LINKS_PER_BUCKET)))
    base = g.work.save(nodes.join(degree.select(F.col("source").alias("id"), F.lit(False).alias("dangling")), "id", "left").select("id", F.coalesce("dangling", F.lit(True)).alias("dangling")))
    rank = base.withColumn("rank", F.lit(1.0 / n))
    for i in range(iterations):
        lost = rank.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("lost"))
        flow = links.join(rank.select(F.col("id").alias("source"), "rank"), "source").groupBy(F.col("target").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
        step = base.join(flow, "id", "left").join(F.broadcast(lost)).select("id", "dangling", (F.lit((1 - damping) / n) + damping * (F.coalesce("flow", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        rank = g.work.save(step)
    return rank.select("id", "rank")


def class_cohesion(g: Graph) -> DataFrame:
    """id, methods, lcom4: groups of a class's methods that share no attribute and no call.

    Dunder, abstract, static and class methods are out. A class with a method whose attributes were
    not recorded is left out, as is one without methods that count.
    """
    meta = lambda path: F.get_json_object("metadata", path)
    methods = g.nodes.where("type = 'METHOD'").select(F.col("id").alias("method"), "name", F.from_json(meta("$.self_attrs"), "array<string>").alias("attrs"), meta("$.is_abstract").alias("abstract"), F.coalesce(F.from_json(meta("$.decorators"), "array<string>"), F.array().cast("array<string>")).alias("decorators"))
    classes = g.nodes.where("type = 'CLASS' and namespace = 'INTERNAL'").select(F.col("id").alias("class"))
    owned = g.typed("DECLARES").select(F.col("source").alias("class"), F.col("target").alias("method")).distinct().join(classes, "class", "left_semi").join(methods, "method")
    stale = owned.where("attrs is null").select("class").distinct()
    not_instance = F.exists("decorators", lambda d: F.element_at(F.split(d, "[.]"), -1).isin("staticmethod", "classmethod"))
    counted = owned.join(stale, "class", "left_anti").where(~(F.col("name").startswith("__") & F.col("name").endswith("__")) & (F.coalesce("abstract", F.lit("false")) != "true") & ~not_instance)
    counted = g.work.save(counted.select("class", "method", "name", "attrs"))
    part = lambda *c: F.concat_ws("\x00", *c)
    links = counted.select(part("class", F.lit("m"), "method").alias("a"), F.explode(F.concat("attrs", F.array("name"))).alias("attr"), "class").select("a", part("class", F.lit("a"), "attr").alias("b"))
    owner = counted.select("class", "method")
    calls = g.typed("CALLS").select("source", "target").distinct().join(owner.select(F.col("class").alias("c1"), F.col("method").alias("source")), "source").join(owner.select(F.col("class").alias("c2"), F.col("method").alias("target")), "target").where("c1 = c2")
    links = links.unionByName(calls.select(part("c1", F.lit("m"), "source").alias("a"), part("c1", F.lit("m"), "target").alias("b")))
    groups = connected_components(links, g.work)
    own = counted.select("class", part("class", F.lit("m"), "method").alias("id")).distinct()
    return own.join(groups, "id").groupBy(F.col("class").alias("id")).agg(F.count("*").alias("methods"), F.countDistinct("component").alias("lcom4"))


def _lifted_calls(g: Graph, owners: DataFrame) -> DataFrame:
    s = owners.select(F.col("method").alias("source"), F.col("class").alias("sc"))
    t = owners.select(F.col("method").alias("target"), F.col("class").alias("tc"))
    e = g.typed("CALLS").select("source", "target").distinct().join(s, "source", "left").join(t, "target", "left")
    return e.select(F.coalesce("sc", "source").alias("src"), F.coalesce("tc", "target").alias("dst"), "sc").where("src <> dst")


def method_owners(g: Graph) -> DataFrame:
    """method, class: what contains or declares each method; of several the greatest."""
    methods = g.nodes.where("type = 'METHOD'").select(F.col("id").alias("target"))
    return g.typed(*STRUCTURAL).join(methods, "target", "left_semi").groupBy(F.col("target").alias("method")).agg(F.max("source").alias("class"))


def class_coupling(g: Graph) -> DataFrame:
    """id, ca, ce: distinct classes or functions that call an internal class's methods, and that they call."""
    classes = g.nodes.where("type = 'CLASS' and namespace = 'INTERNAL'").select("id", "metadata")
    calls = _lifted_calls(g, method_owners(g)).select("src", "dst").distinct()
    ca = calls.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("ca"))
    ce = calls.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("ce"))
    rows = classes.join(ca, "id", "left").join(ce, "id", "left").na.fill(0, ["ca", "ce"])
    return rows.select("id", "ca", "ce", (F.coalesce(F.get_json_object("metadata", "$.is_abstract"), F.lit("false")) == "true").alias("is_abstract"))


def zone_of_pain(g: Graph, min_afferent: int = 3, max_instability: float = 0.30, min_distance: float = 0.70) -> DataFrame:
    """id, ca, ce, instability, distance of classes that many rely on and that are hard to change."""
    rows = class_coupling(g).where(F.col("ca") >= min_afferent).withColumn("instability", F.col("ce") / (F.col("ca") + F.col("ce")))
    rows = rows.withColumn("distance", F.abs(F.col("is_abstract").cast("double") + F.col("instability") - 1.0))
    return rows.where((F.col("instability") <= max_instability) & (F.col("distance") >= min_distance)).select("id", "ca", "ce", "instability", "distance")


def god_objects(g: Graph, min_methods: int = 10, min_efferent: int = 5) -> DataFrame:
    """id, methods, efferent, severity of classes with many methods that call many others."""
    classes = g.nodes.where("type = 'CLASS' and namespace = 'INTERNAL'").select(F.col("id").alias("class"))
    owners = method_owners(g).join(classes, "class", "left_semi")
    methods = owners.groupBy(F.col("class").alias("id")).agg(F.count("*").alias("methods"))
    out = _lifted_calls(g, owners).where("sc is not null").select("src", "dst").distinct().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("efferent"))
    rows = methods.join(out, "id").where((F.col("methods") >= min_methods) & (F.col("efferent") >= min_efferent))
    return rows.withColumn("severity", F.least(F.lit(1.0), F.col("methods") / min_methods * (F.col("efferent") / min_efferent) / 4))


def orphan_classes(g: Graph) -> DataFrame:
    """id: internal module-level classes, no tests and not generated, that no production code uses."""
    classes = g.internal("CLASS").where("not is_test and not is_generated").select("id")
    parents = g.nodes.where("type in ('CLASS', 'FUNCTION', 'METHOD')").select(F.col("id").alias("parent"))
    own = classes.withColumn("parent", F.regexp_replace("id", r"\.[^.]*$", ""))
    nested = own.where("parent <> id").join(parents, "parent", "left_semi").select("id")
    sources = g.nodes.where("not is_test").select(F.col("id").alias("source"))
    used = g.meet(g.typed(*USE_TYPES).select("source", "target"), sources, "source", "left_semi").select(F.col("target").alias("id")).distinct()
    return classes.join(nested, "id", "left_anti").join(used, "id", "left_anti")
