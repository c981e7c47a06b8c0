"""Raw references linked to nodes in a fixed order of rules, and nodes made for what lies outside.

Each rule is a join that names at most one node for a reference; the first rule that does wins. References are
few columns wide and meet indexes that have one row for a key, so no rule compares a reference with several nodes.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairngraph.operators.structure import suffixes
from cairngraph.schema import EXTERNAL_PATH
from cairngraph.workspace import Workspace

# What a linked, a kept and an unplaced reference is worth, and the most into outside code of unknown origin.
SURE, KEPT, BARE, UNKNOWN_MOST = 1.0, 0.8, 0.5, 0.8
RAW = r"^raw_(call|class|dep|import):"
#: How many levels of bases a method on self is looked for.
MOST_BASES = 64


@dataclass(frozen=True)
class Index:
    """The nodes' names, one row for a key: ids (id, type, language, file_path), tails (suffix, id: of one node only), globals and locals (name to id, unique in a language or file), roots (root: first parts of internal ids), prefixes (prefix: parts that imports put before ids)."""

    ids: DataFrame
    tails: DataFrame
    globals: DataFrame
    locals: DataFrame
    variables: DataFrame
    roots: DataFrame
    prefixes: list[str]
    outside: DataFrame


def head(c: Column | str) -> Column:
    return F.substring_index(c, ".", 1)


def tail(c: str) -> Column:
    """What follows the first part, with its dot; '' for a single part."""
    return F.expr(f"substring({c}, length(substring_index({c}, '.', 1)) + 1)")


def build_index(nodes: DataFrame, imports: DataFrame, work: Workspace) -> Index:
    """``imports``: file_path, name, full: what each file calls an imported name, and its full name.

    A root of imports is first party if what follows it names a node for any of its full names; if for two, it is a
    prefix that ids lack. The other roots are outside.
    """
    ids = work.save(nodes.where("namespace = 'INTERNAL'").select("id", "name", "type", "language", "file_path"))
    every = suffixes(ids.select("id"), "id").where("start > 0").groupBy("suffix").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    tails = work.save(every.where("n = 1").select("suffix", "id"))
    one = lambda d, *by: d.groupBy("name", *by).agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1").drop("n")
    code, di = ids.where(F.col("type").isin("FUNCTION", "METHOD", "CLASS")), ids.where("type = 'VARIABLE'")
    full = imports.select("full").where("full is not null").distinct()
    roots = ids.select(head("id").alias("root")).distinct()
    stripped = full.select(head("full").alias("root"), F.substr(tail("full"), F.lit(2)).alias("id")).where("id <> ''")
    met = stripped.join(ids.select("id"), "id", "left_semi").groupBy("root").agg(F.count("*").alias("n"))
    met = work.save(met.join(roots, "root", "left_anti"))
    # First-party roots are directories above the graph: a handful, and each a setting of the linking.
    prefixes = sorted(r[0] for r in met.where("n >= 2").select("root").toLocalIterator())
    own = work.save(roots.unionByName(met.select("root")).distinct())
    outside = full.select(head("full").alias("root")).distinct().join(own, "root", "left_anti")
    return Index(ids, tails, work.save(one(code, "language")), work.save(one(code, "file_path")), work.save(one(di, "file_path").unionByName(one(di).withColumn("file_path", F.lit(None).cast("string")))), own, prefixes, work.save(outside))


def place(names: DataFrame, index: Index, reexports: DataFrame | None = None) -> DataFrame:
    """name, id of the names that are, or stand for, a node: the id itself; the one id that ends so; where the root is not outside, the
    id behind known prefixes; else the same of what a re-export (symbol, final) forwards to."""
    asked = names.select("name").where("name is not null and name <> ''").distinct()
    tries = asked if reexports is None else asked.join(reexports.withColumnRenamed("symbol", "name"), "name", "left")
    forms = [F.struct(F.lit(0).alias("rank"), F.col("name").alias("form"), F.lit(True).alias("whole"))]
    forms += [] if reexports is None else [F.when(F.col("final").isNotNull(), F.struct(F.lit(10).alias("rank"), F.col("final").alias("form"), F.lit(True).alias("whole")))]
    rows = tries.select("name", F.explode(F.filter(F.array(*forms), lambda x: x.isNotNull())).alias("f")).select("name", "f.rank", "f.form")
    parts = F.split("form", "[.]")
    known = F.array(*[F.lit(p) for p in index.prefixes]) if index.prefixes else F.array().cast("array<string>")
    cuts = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    led = F.filter(cuts, lambda k: F.forall(F.slice(parts, 1, k), lambda p: F.array_contains(known, p)))
    exact = rows.join(index.ids.select(F.col("id").alias("form")), "form", "left_semi").select("name", "rank", F.col("form").alias("id"))
    ends = rows.join(index.tails.withColumnRenamed("suffix", "form"), "form").select("name", (F.col("rank") + 1).alias("rank"), "id")
    home = rows.withColumn("root", head("form")).join(index.outside, "root", "left_anti")
    short = home.select("name", "rank", F.posexplode(F.transform(led, lambda k: F.array_join(F.slice(parts, k + 1, F.size(parts)), "."))).alias("nth", "id"))
    short = short.join(index.ids.select("id"), "id", "left_semi").groupBy("name", "rank").agg(F.min_by("id", "nth").alias("id")).withColumn("rank", F.col("rank") + 2)
    return exact.unionByName(ends).unionByName(short).groupBy("name").agg(F.min_by("id", "rank").alias("id"))


def methods_on_self(nodes: DataFrame, edges: DataFrame, asked: DataFrame, work: Workspace) -> DataFrame:
    """source, name, id: the method ``name`` of the class that ``source`` belongs to, or of the nearest base that has one; of equally near ones the least."""
    owner = F.regexp_replace("id", r"\.[^.]*$", "")
    methods = work.save(nodes.where("type = 'METHOD'").select("id", "name", owner.alias("class")))
    bases = work.save(edges.where("type = 'EXTENDS'").select(F.col("source").alias("class"), F.col("target").alias("base")).where("class <> base").distinct())
    front = work.save(asked.select("source", "name").distinct().join(methods.select(F.col("id").alias("source"), "class"), "source").select("source", "name", "class"))
    seen, found = front, []
    for _ in range(MOST_BASES):
        if not front.take(1):
            break
        hit = work.save(front.join(methods, ["class", "name"]).groupBy("source", "name").agg(F.min("id").alias("id")))
        found.append(hit)
        up = front.join(hit.select("source", "name"), ["source", "name"], "left_anti").join(bases, "class").select("source", "name", F.col("base").alias("class")).distinct()
        front = work.save(up.join(seen, ["source", "name", "class"], "left_anti"))
        seen = seen.unionByName(front)
    out = found[0] if found else methods.select(F.col("id").alias("source"), "name", "id").where("false")
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def link(nodes: DataFrame, edges: DataFrame, imports: DataFrame, work: Workspace, reexports: DataFrame | None = None) -> DataFrame:
    """Edges with their raw targets linked; ``edges`` has id, source, target, type, confidence, file_path and may have more.

    A call on self is looked for in the class and its bases. Another call or a base: what the file imported under the name's
    first part, then the one node of its last part in the language, then in the file; for a base with dots the node must end with it. A
    dependency: an imported name must be an injected variable (or a class, which makes the edge a REFERENCES), else the variable of that name in the
    file, then anywhere; otherwise the edge goes. An import that names no node goes, too. What is not placed keeps its bare name,
    or its raw one where a node of other meaning has that. Final targets are only freed of prefixes.
    """
    index = build_index(nodes, imports, work)
    name = F.when(F.col("target").startswith("self."), F.substr("target", F.lit(6))).otherwise(F.regexp_replace("target", RAW, ""))
    kind = F.when(F.col("target").startswith("self."), "self").when(F.col("target").rlike(RAW), F.regexp_extract("target", RAW, 1)).otherwise("final")
    sources = nodes.select(F.col("id").alias("source"), "language", F.col("file_path").alias("_own"))
    e = edges.withColumn("_kind", kind).withColumn("_name", name).join(sources.dropDuplicates(["source"]), "source", "left")
    e = e.withColumn("_file", F.coalesce("file_path", "_own")).withColumn("_head", head("_name"))
    known_as = imports.where("name is not null and full is not null").groupBy(F.col("file_path").alias("_file"), F.col("name").alias("_head")).agg(F.min("full").alias("_full"))
    e = work.save(e.join(known_as, ["_file", "_head"], "left").withColumn("_path", F.when(F.col("_kind").isin("call", "class", "dep") & F.col("_full").isNotNull(), F.concat("_full", tail("_name"))).when(F.col("_kind").isin("import", "final"), F.col("_name"))))
    placed = place(e.select(F.col("_path").alias("name")), index, reexports).select(F.col("name").alias("_path"), F.col("id").alias("_placed"))
    on_self = methods_on_self(nodes, edges, e.where("_kind = 'self'").select("source", F.col("_name").alias("name")), work).select("source", F.col("name").alias("_name"), F.lit("self").alias("_kind"), F.col("id").alias("_self"))
    last = F.substring_index("_name", ".", -1)
    e = e.withColumn("_last", last).join(placed, "_path", "left").join(on_self, ["source", "_name", "_kind"], "left")
    e = e.join(index.globals.select(F.col("name").alias("_last"), "language", F.col("id").alias("_global")), ["_last", "language"], "left")
    e = e.join(index.locals.select(F.col("name").alias("_last"), F.col("file_path").alias("_file"), F.col("id").alias("_local")), ["_last", "_file"], "left")
    near = index.variables.where("file_path is not null").select(F.col("name").alias("_name"), F.col("file_path").alias("_file"), F.col("id").alias("_near"))
    far = index.variables.where("file_path is null").select(F.col("name").alias("_name"), F.col("id").alias("_far"))
    e = e.join(near, ["_name", "_file"], "left").join(far, "_name", "left")
    shape = index.ids.select(F.col("id").alias("_placed"), F.col("type").alias("_shape"))
    e = e.join(shape, "_placed", "left")
    spread = F.coalesce("_global", "_local")
    dotted = F.contains("_name", F.lit("."))
    spread = F.when(~dotted | (spread == F.col("_name")) | spread.endswith(F.concat(F.lit("."), "_name")) | (F.col("_kind") == "call") & ~dotted, spread)
    imported = F.col("_full").isNotNull()
    dep = F.when(imported, F.when(F.col("_shape").isin("VARIABLE", "CLASS"), F.col("_placed"))).otherwise(F.coalesce("_far", "_near"))
    found = F.when(F.col("_kind") == "self", F.col("_self")).when(F.col("_kind").isin("call", "class"), F.coalesce("_placed", spread)).when(F.col("_kind") == "dep", dep).otherwise(F.col("_placed"))
    e = e.withColumn("_found", found).where("_found is not null or _kind not in ('dep', 'import')")
    taken = index.ids.select(F.col("id").alias("_name"), F.lit(True).alias("_taken"))
    e = e.join(taken, "_name", "left")
    bare = F.when(F.col("_kind") == "final", F.col("target")).when(F.col("_taken"), F.col("target")).otherwise(F.col("_name"))
    worth = F.when(F.col("_kind") == "final", F.col("confidence")).when(F.col("_found").isNotNull(), SURE).when(F.col("_kind") == "class", BARE).otherwise(KEPT)
    made = F.when((F.col("_kind") == "dep") & imported & (F.col("_shape") == "CLASS"), "REFERENCES").otherwise(F.col("type"))
    new = {"target": F.coalesce("_found", bare), "confidence": worth, "type": made}
    return e.select(*[new.get(c, F.col(c)).alias(c) for c in edges.columns])


def outside_nodes(nodes: DataFrame, edges: DataFrame, outside: DataFrame) -> DataFrame:
    """id, type, name, file_path, language, namespace, confidence_score of the targets that have no node.

    Told from the caller's language: Python's own modules are STDLIB, roots of imports that no node lies below (``outside``: root) EXTERNAL, the
    rest, also what seems internal and has no node, UNKNOWN. Of several readings of one name a known one counts, then that of the least language.
    """
    used = edges.select("source", F.col("target").alias("id")).where("id is not null").join(nodes.select("id"), "id", "left_anti")
    used = used.join(nodes.select(F.col("id").alias("source"), "language"), "source", "left").select("id", F.coalesce("language", F.lit("")).alias("language")).distinct()
    plain = F.regexp_replace("id", r"^raw_call:", "")
    std = F.when((F.col("language") == "python") & head(plain).isin(*sorted(sys.stdlib_module_names)), "STDLIB")
    told = used.withColumn("root", head(plain)).join(outside.select("root").distinct().withColumn("_out", F.lit("EXTERNAL")), "root", "left").withColumn("namespace", F.coalesce(std, "_out", F.lit("UNKNOWN")))
    best = told.groupBy("id").agg(F.min(F.struct((F.col("namespace") == "UNKNOWN").alias("unknown"), "language", "namespace")).alias("b"))
    return best.select("id", F.lit("FUNCTION").alias("type"), F.substring_index(plain, ".", -1).alias("name"), F.lit(EXTERNAL_PATH).alias("file_path"), "b.language", "b.namespace", F.lit(KEPT).alias("confidence_score"))


def agreed(edges: DataFrame, made: DataFrame) -> DataFrame:
    """Edges into made nodes of unknown origin are worth no more than 0.8."""
    unknown = made.where("namespace = 'UNKNOWN'").select(F.col("id").alias("target"), F.lit(True).alias("_unknown"))
    e = edges.join(unknown, "target", "left")
    return e.select(*[F.when(F.col("_unknown"), F.least("confidence", F.lit(UNKNOWN_MOST))).otherwise(F.col("confidence")).alias(c) if c == "confidence" else F.col(c) for c in edges.columns])
