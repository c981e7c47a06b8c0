"""Names people give, turned into ids; filters on ids; and the answers built from several operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairngraph.functions.text import col, trimmed, under
from cairngraph.graph import Graph
from cairngraph.operators import metrics, storage, traversal
from cairngraph.operators.skew import extent, sized_join
from cairngraph.operators.structure import suffixes

# Alternatives that are listed for an ambiguous name; rows and parts of an overview; a lookup's walk.
MOST_CANDIDATES = 10
OVERVIEW_ROWS, OVERVIEW_DEPTH = 15, 2
LOOKUP_DEPTH, LOOKUP_NODES = 2, 40


def terms(given: str | Sequence[str] | None) -> list[str]:
    """Filter terms without blanks, trimmed, each once; a bare string is one term, None is none."""
    given = [] if given is None else [given] if isinstance(given, str) else given
    return list(dict.fromkeys(t.strip() for t in given if t and t.strip()))


def without_segments(c: Column | str, segments: str | Sequence[str] | None) -> Column:
    """True for ids in which none of ``segments`` stands as whole parts, anywhere."""
    padded, keep = F.concat(F.lit("."), col(c), F.lit(".")), F.lit(True)
    for s in terms(segments):
        keep = keep & ~F.contains(padded, F.lit(f".{s}."))
    return keep


def in_scope(c: Column | str, prefixes: str | Sequence[str] | None) -> Column:
    """True for ids that are one of ``prefixes`` or lie below it at a dot; no prefixes let all pass."""
    asked = terms(prefixes)
    keep = F.lit(not asked)
    for p in asked:
        keep = keep | under(c, p)
    return keep


def path_roots(root: str, sources: Iterable[str] = ()) -> list[str]:
    """Dotted tails of the directory a graph was read from, and of its source roots: what a name may begin with that no id does."""
    top = PurePosixPath(root.replace("\\", "/"))
    bases = [top, *(top / s.replace("\\", "/") for s in sources)]
    return sorted({".".join(b.parts[i:]) for b in bases for i in range(1, len(b.parts))})


def fetch_nodes(g: Graph, ids: DataFrame) -> DataFrame:
    """Nodes of the asked ``id``s, each once; unknown ids give no row."""
    asked = g.work.save(ids.select("id").distinct())
    return sized_join(g.nodes, asked, ["id"], "left_semi", extent(asked), big_rows=0)


def covers_internal(g: Graph, prefix: str) -> DataFrame:
    """One row, covered: is any internal node ``prefix`` or below it."""
    hit = g.nodes.where((F.col("namespace") == "INTERNAL") & under("id", prefix)).limit(1)
    return hit.agg((F.count("*") > 0).alias("covered"))


def is_package(g: Graph, prefix: str) -> bool:
    return bool(storage.files_under(g, prefix).take(1))


def _drops(name: str, roots: Sequence[str], longest_first: bool) -> Column:
    """The rests of a dotted name behind a head that is one of ``roots``, in order."""
    parts = F.split(name, "[.]")
    cuts = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    cuts = F.filter(cuts, lambda k: F.array_join(F.slice(parts, 1, k), ".").isin(*roots) if roots else F.lit(False))
    cuts = F.reverse(cuts) if longest_first else cuts
    return F.transform(cuts, lambda k: F.array_join(F.slice(parts, k + 1, F.size(parts)), "."))


def resolve_names(g: Graph, names: DataFrame, roots: Sequence[str] = ()) -> DataFrame:
    """name, resolved, via_suffix, candidates, truncated for each distinct trimmed ``name``.

    In order: the id itself; the one id that ends with the name at a dot; what is left behind the
    shortest head that is one of ``roots`` (see ``path_roots``), if that is an id. Several ids that end
    so are listed as candidates, the least ten, ``truncated`` if there are more. A blank or null name resolves to
    nothing. Every id's tails meet the asked names in one join, whatever their number.
    """
    asked = g.work.save(names.select(F.coalesce(trimmed("name"), F.lit("")).alias("name")).distinct())
    exact = asked.join(g.nodes.select(F.col("id").alias("name")), "name", "left_semi").where("name <> ''")
    rest = g.work.save(asked.where("name <> ''").join(exact, "name", "left_anti"))
    tails = suffixes(g.nodes.select("id"), "id").where("start > 0").select("id", F.col("suffix").alias("name"))
    hits = sized_join(tails, rest, ["name"], "inner", extent(rest))
    # No more than one row above the limit of a name is kept, before names are brought together.
    nth = F.row_number().over(Window.partitionBy("name").orderBy("id"))
    few = hits.withColumn("nth", nth).where(F.col("nth") <= MOST_CANDIDATES + 1)
    found = g.work.save(few.groupBy("name").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    tried = rest.join(found, "name", "left_anti").select("name", F.posexplode(_drops("name", list(roots), False)).alias("nth", "id"))
    dropped = tried.join(g.nodes.select("id"), "id", "left_semi").groupBy("name").agg(F.min_by("id", "nth").alias("short"))
    none = F.array().cast("array<string>")
    many = F.size("ids") > 1
    out = asked.join(exact.withColumn("own", F.lit(True)), "name", "left").join(found, "name", "left").join(dropped, "name", "left")
    resolved = F.when(F.col("own"), F.col("name")).when(F.size("ids") == 1, F.col("ids")[0]).otherwise(F.col("short"))
    return out.select("name", resolved.alias("resolved"), (resolved.isNotNull() & F.col("own").isNull()).alias("via_suffix"), F.when(many, F.slice("ids", 1, MOST_CANDIDATES)).otherwise(none).alias("candidates"), F.coalesce(F.size("ids") > MOST_CANDIDATES, F.lit(False)).alias("truncated"))


def effective_prefixes(g: Graph, prefixes: DataFrame, roots: Sequence[str] = ()) -> DataFrame:
    """prefix, effective: the prefix itself where internal code is it or lies below it, else the rest behind the longest head among ``roots`` for which that holds, else the prefix."""
    asked = g.work.save(prefixes.select(trimmed("prefix").alias("prefix")).where("prefix <> ''").distinct())
    tries = g.work.save(asked.select("prefix", F.posexplode(F.concat(F.array("prefix"), _drops("prefix", list(roots), True))).alias("nth", "head")))
    parts = F.split("id", "[.]")
    heads = g.nodes.where("namespace = 'INTERNAL'").select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))).alias("head"))
    # Heads are many and repeat; only the asked ones, each once, go on.
    wanted = tries.select("head").distinct()
    covered = sized_join(heads, wanted, ["head"], "left_semi", extent(wanted)).distinct()
    best = tries.join(covered, "head", "left_semi").groupBy("prefix").agg(F.min_by("head", "nth").alias("best"))
    return asked.join(best, "prefix", "left").select("prefix", F.coalesce("best", "prefix").alias("effective"))


def overview_packages(g: Graph, depth: int = OVERVIEW_DEPTH, limit: int = OVERVIEW_ROWS) -> DataFrame:
    """kind (production, test), nth, prefix, symbols, omitted: the largest packages of each kind; ``omitted`` counts those not listed."""
    census = g.work.save(storage.package_census(g, max(depth, 1)))
    kinds = [census.where(f"{c} > 0").select(F.lit(k).alias("kind"), "prefix", F.col(c).alias("symbols")) for k, c in (("production", "n_production"), ("test", "n_test"))]
    rows = kinds[0].unionByName(kinds[1])
    total = rows.groupBy("kind").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("symbols"), "prefix"))
    top = rows.withColumn("nth", nth).where(F.col("nth") <= max(limit, 1))
    return top.join(F.broadcast(total), "kind").select("kind", "nth", "prefix", "symbols", F.greatest(F.col("n") - max(limit, 1), F.lit(0)).alias("omitted"))


def architecture_report(g: Graph, exclude: Sequence[str] = (), scope: Sequence[str] = (), limits: dict[str, int] | None = None) -> DataFrame:
    """section, nth, id, first, second: the most coupled nodes (calls in, out), classes with most members, highest
    PageRank, most coupled files (afferent, efferent), least cohesive classes (lcom4, methods) and one row of
    resolution (unresolved, total, of edges whose source passes).

    ``exclude`` and ``scope`` choose what is ranked; calls and files outside still count, but for
    PageRank, whose universe leaves the excluded out.
    """
    most = {"bottlenecks": 10, "god_classes": 5, "critical": 10, "file_coupling": 10, "cohesion": 10, **(limits or {})}
    keep = without_segments("id", exclude) & in_scope("id", scope)

    def top(section: str, rows: DataFrame, first: str, second: str | None, order: list) -> DataFrame:
        ranked = rows.where(keep).orderBy(*order).limit(most[section])
        nth = F.row_number().over(Window.orderBy(*order))  # as many rows as the limit
        return ranked.select(F.lit(section).alias("section"), nth.alias("nth"), "id", F.col(first).cast("double").alias("first"), (F.col(second) if second else F.lit(None)).cast("double").alias("second"))

    rank = metrics.pagerank(g, exclude=terms(exclude))
    parts = [
        top("bottlenecks", metrics.node_coupling(g), "in_degree", "out_degree", [F.desc(F.col("in_degree") + F.col("out_degree")), "id"]),
        top("god_classes", metrics.god_classes(g), "declares", None, [F.desc("declares"), "id"]),
        top("critical", rank.withColumn("rank", F.round("rank", 12)), "rank", None, [F.desc("rank"), "id"]),
        top("file_coupling", metrics.file_coupling(g), "afferent", "efferent", [F.desc(F.col("afferent") + F.col("efferent")), "id"]),
        top("cohesion", metrics.class_cohesion(g), "lcom4", "methods", [F.desc("lcom4"), F.desc("methods"), "id"]),
    ]
    ratio = storage.resolution_of(g, without_segments("source", exclude) & in_scope("source", scope))
    out = ratio.select(F.lit("resolution").alias("section"), F.lit(1).alias("nth"), F.lit(None).cast("string").alias("id"), F.col("unresolved").cast("double").alias("first"), F.col("total").cast("double").alias("second"))
    for p in parts:
        out = out.unionByName(p)
    return out


def class_context(g: Graph, focus: str) -> tuple[DataFrame, DataFrame]:
    """(the class that holds ``focus``, its other members by file, line and id); empty for what lies in no class."""
    up = g.typed("CONTAINS", "DECLARES").where(F.col("target") == focus).select(F.col("source").alias("id"))
    owner = g.work.save(g.nodes.join(F.broadcast(up.distinct()), "id", "left_semi").where("type = 'CLASS'").orderBy("id").limit(1))
    links = g.typed("CONTAINS", "DECLARES").join(F.broadcast(owner.select(F.col("id").alias("source"))), "source", "left_semi")
    members = g.nodes.join(F.broadcast(links.select(F.col("target").alias("id")).where(F.col("id") != focus).distinct()), "id", "left_semi")
    return owner, members.orderBy("file_path", "start_line", "id")


def answer_lookups(g: Graph, names: Sequence[str], roots: Sequence[str] = ()) -> DataFrame:
    """name, resolved, caller, depth, omitted: who calls each name, two steps up, tests and outside code left out, at most 40 nodes.

    A name that resolves to nothing, or to a node nobody calls, has one row without caller. The names
    are a question's few; each is one walk.
    """
    spark = g.work.spark
    found = {r["name"]: r["resolved"] for r in resolve_names(g, spark.createDataFrame([(n,) for n in names], "name string"), roots).collect()}
    out = spark.createDataFrame([], "name string, resolved string, caller string, depth int, omitted int")
    for name in dict.fromkeys(n.strip() for n in names):
        node = found.get(name)
        row = spark.createDataFrame([(name, node)], "name string, resolved string")
        if node is None:
            out = out.unionByName(row.select("*", F.lit(None).cast("string").alias("caller"), F.lit(None).cast("int").alias("depth"), F.lit(0).alias("omitted")))
            continue
        walk = traversal.walk(g, [node], True, LOOKUP_DEPTH, hide_tests=True, internal_only=True, budget=LOOKUP_NODES)
        callers = walk.reached.where(F.col("id") != node)
        out = out.unionByName(row.join(callers.select(F.col("id").alias("caller"), "depth"), how="left", on=F.lit(True)).select("name", "resolved", "caller", "depth", F.lit(walk.omitted).alias("omitted")))
    return out
