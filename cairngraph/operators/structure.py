"""Files and packages as a graph: module edges, their reduction, communities and how the layout agrees."""

from __future__ import annotations

from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairngraph.functions.text import under
from cairngraph.graph import Graph
from cairngraph.operators.components import strong_components
from cairngraph.schema import RAW_CALL
from cairngraph.workspace import Workspace

#: Which edges make a layer of the module graph.
LAYERS = {"imports": ["IMPORTS", "IMPORTS_SYMBOL"], "extends": ["EXTENDS"], "calls": ["CALLS"]}


def suffixes(ids: DataFrame, column: str) -> DataFrame:
    """Adds start and suffix: each dotted tail of ``column`` and the place it begins, 0 for the whole."""
    parts = F.split(column, "[.]")
    tails = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(i.alias("start"), F.array_join(F.slice(parts, i + 1, F.size(parts)), ".").alias("suffix")))
    return ids.withColumn("_s", F.explode(tails)).select(*ids.columns, "_s.start", "_s.suffix")


def resolve_to_files(names: DataFrame, files: DataFrame) -> DataFrame:
    """name, file: each name (column ``name``) is a file (``id``) itself, or the one its longest tail names alone."""
    own = suffixes(files.select("id"), "id").groupBy("suffix").agg(F.min("id").alias("file"), F.countDistinct("id").alias("n")).where("n = 1").drop("n")
    # A file's own id names it, whatever other file ends the same way.
    own = own.join(files.select(F.col("id").alias("suffix")), "suffix", "left_anti").unionByName(files.select(F.col("id").alias("suffix"), F.col("id").alias("file")))
    exact = files.select(F.col("id").alias("name"), F.col("id").alias("file"))
    asked = names.select("name").distinct()
    tails = suffixes(asked.where(~F.col("name").startswith(RAW_CALL)), "name").join(own, "suffix")
    found = tails.groupBy("name").agg(F.min_by("file", "start").alias("file"))
    return asked.join(exact, "name", "left_semi").select("name", F.col("name").alias("file")).unionByName(found.join(exact.select("name"), "name", "left_anti"))


def file_graph(g: Graph, prefix: str, with_calls: bool = True) -> DataFrame:
    """a, b, weight: the symmetric graph of files and modules under ``prefix`` by imports and calls."""
    files = g.nodes.where(F.col("type").isin("FILE", "MODULE")).where(under("id", prefix)).select("id")
    e = g.typed("IMPORTS", *(["CALLS"] if with_calls else [])).groupBy("source", "target").agg(F.sum("weight").alias("weight"))
    names = e.select(F.col("source").alias("name")).unionByName(e.select(F.col("target").alias("name")))
    to = g.work.save(resolve_to_files(names, files))
    ends = e.join(to.select(F.col("name").alias("source"), F.col("file").alias("x")), "source").join(to.select(F.col("name").alias("target"), F.col("file").alias("y")), "target").where("x <> y").select("x", "y", "weight")
    both = ends.unionByName(ends.select(F.col("y").alias("x"), F.col("x").alias("y"), "weight"))
    return both.groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("weight").alias("weight"))


def direct_child(c: Column, prefix: str) -> Column:
    rest = F.substring_index(F.substr(c, F.lit(len(prefix) + 2)), ".", 1)
    return F.when(c.startswith(prefix + "."), F.concat(F.lit(prefix + "."), rest)).otherwise(c)


def children_graph(files: DataFrame, prefix: str) -> DataFrame:
    """A file graph with each sub-package as one node."""
    lifted = files.select(direct_child(F.col("a"), prefix).alias("a"), direct_child(F.col("b"), prefix).alias("b"), "weight")
    return lifted.where("a <> b").groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def _greedy(files: list[str], adj: dict[str, dict[str, float]]) -> tuple[list[list[str]], float]:
    """Merges the two communities that gain most modularity until none gains, ties by name."""
    degree = {f: sum(adj.get(f, {}).values()) for f in files}
    double = sum(degree.values())
    if double <= 0:
        return [[f] for f in files], 0.0
    members, links = {f: [f] for f in files}, {f: dict(adj.get(f, {})) for f in files}
    weight = dict(degree)
    gain = lambda c, d: 2 * (links[c][d] / double - weight[c] * weight[d] / double**2)
    # The best pair is on top; what a merge has made out of date is known by its gain.
    heap = [(-gain(c, d), c, d) for c in files for d in links[c] if c < d and links[c][d] > 0]
    heapify(heap)
    while heap:
        best, c, d = heappop(heap)
        if c not in members or d not in members or d not in links[c] or -gain(c, d) != best:
            continue
        if -best <= 1e-12:
            break
        members[c] += members.pop(d)
        weight[c] += weight.pop(d)
        for x, w in links.pop(d).items():
            links[x].pop(d, None)
            if x != c:
                links[c][x] = links[c].get(x, 0.0) + w
                links[x][c] = links[x].get(c, 0.0) + w
        links[c].pop(c, None)
        links[c].pop(d, None)
        for x, w in links[c].items():
            if w > 0:
                heappush(heap, (-gain(*sorted((c, x))), *sorted((c, x))))
    label = {f: c for c, fs in members.items() for f in fs}
    q = sum(w for f, row in adj.items() for x, w in row.items() if label[f] == label[x]) / double
    return sorted(sorted(fs) for fs in members.values()), q - sum((w / double) ** 2 for w in weight.values())


def communities(graphs: DataFrame, files: DataFrame) -> DataFrame:
    """package, id, community, modularity by greedy merging, package by package.

    ``graphs``: package, a, b, weight; ``files``: package, id. The merges of one package depend on each
    other, so a package is one task; packages are independent.
    """

    def run(key, edges: pd.DataFrame, ids: pd.DataFrame) -> pd.DataFrame:
        adj: dict[str, dict[str, float]] = {}
        for a, b, w in zip(edges["a"], edges["b"], edges["weight"]):
            adj.setdefault(a, {})[b] = w
        groups, q = _greedy(sorted(ids["id"]), adj)
        return pd.DataFrame([(key[0], f, group[0], q) for group in groups for f in group], columns=["package", "id", "community", "modularity"])

    return graphs.groupBy("package").cogroup(files.groupBy("package")).applyInPandas(run, "package string, id string, community string, modularity double")


def package_graphs(g: Graph) -> tuple[DataFrame, DataFrame]:
    """(package, a, b, weight) and (package, id): the file graphs of all top packages at once.

    For each package an end is the file of it that its longest tail names alone, as in ``file_graph``,
    so an end written with another root still links.
    """
    files = g.work.save(g.internal("FILE", "MODULE").select("id", F.substring_index("id", ".", 1).alias("package")))
    e = g.typed("IMPORTS", "CALLS").groupBy("source", "target").agg(F.sum("weight").alias("weight"))
    own = suffixes(files, "id").groupBy("package", "suffix").agg(F.min("id").alias("file"), F.countDistinct("id").alias("n"), F.max(F.when(F.col("suffix") == F.col("id"), F.col("id"))).alias("itself"))
    own = own.where("n = 1 or itself is not null").select("package", "suffix", F.coalesce("itself", "file").alias("file"))
    names = e.select(F.col("source").alias("name")).unionByName(e.select(F.col("target").alias("name"))).distinct().where(~F.col("name").startswith(RAW_CALL))
    to = g.work.save(suffixes(names, "name").join(own, "suffix").groupBy("package", "name").agg(F.min_by("file", "start").alias("file")))
    s = to.select("package", F.col("name").alias("source"), F.col("file").alias("a"))
    t = to.select("package", F.col("name").alias("target"), F.col("file").alias("b"))
    ends = e.join(s, "source").join(t, ["package", "target"]).where("a <> b").select("package", "a", "b", "weight")
    both = ends.unionByName(ends.select("package", F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    return both.groupBy("package", "a", "b").agg(F.sum("weight").alias("weight")), files.select("package", "id")


def partition_divergence(labels: DataFrame, left: str, right: str, by: list[str]) -> DataFrame:
    """``by``, n, divergence: 1 - mutual information / mean entropy of two labels, in nats; 0 if both are one group."""
    joint = labels.groupBy(*by, left, right).agg(F.count("*").alias("nxy"))
    total = joint.groupBy(*by).agg(F.sum("nxy").alias("n"))
    x = joint.groupBy(*by, left).agg(F.sum("nxy").alias("nx"))
    y = joint.groupBy(*by, right).agg(F.sum("nxy").alias("ny"))
    entropy = lambda t, c, name: t.join(total, by).groupBy(*by).agg(F.sum(-F.col(c) / F.col("n") * F.log(F.col(c) / F.col("n"))).alias(name))
    mutual = joint.join(total, by).join(x, [*by, left]).join(y, [*by, right]).groupBy(*by).agg(F.sum(F.col("nxy") / F.col("n") * F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))).alias("mi"))
    all_ = total.join(entropy(x, "nx", "hx"), by).join(entropy(y, "ny", "hy"), by).join(mutual, by)
    d = F.when((F.col("hx") <= 1e-12) & (F.col("hy") <= 1e-12), F.lit(0.0)).otherwise(1 - F.col("mi") / ((F.col("hx") + F.col("hy")) / 2))
    return all_.select(*by, "n", d.alias("divergence"))


def layout_verdicts(found: DataFrame, graphs: DataFrame, split: float = 0.35, leave: float = 0.25, divergence: float = 0.2, min_connected: float = 0.5) -> DataFrame:
    """package, modularity, divergence, direction, connected, verdict from communities with their directory (``directory``).

    ``connected`` is the share of files with a link in ``graphs``; where it is below ``min_connected`` a
    split or borderline package is left. One file, or no link at all, gives no_signal.
    """
    d = partition_divergence(found, "community", "directory", ["package"])
    counts = found.groupBy("package").agg(F.max("modularity").alias("modularity"), F.countDistinct("community").alias("nc"), F.countDistinct("directory").alias("nd"))
    linked = found.join(graphs.select("package", F.col("a").alias("id")).distinct(), ["package", "id"], "left_semi").groupBy("package").agg(F.count("*").alias("linked"))
    rows = counts.join(d, "package").join(linked, "package", "left").withColumn("connected", F.coalesce(F.col("linked") / F.col("n"), F.lit(0.0))).withColumn("direction", F.when(F.col("nd") < F.col("nc"), "under_split").when(F.col("nd") > F.col("nc"), "over_split").otherwise("matched"))
    q = F.col("modularity")
    verdict = F.when(q < leave, "leave").when(F.col("divergence") < divergence, "aligned").when((q >= split) & (F.col("direction") == "under_split"), "split").when((q >= split) & (F.col("direction") == "over_split"), "consolidate").otherwise("borderline")
    verdict = F.when(verdict.isin("split", "borderline") & (F.col("connected") < min_connected), "leave").otherwise(verdict)
    none = (F.col("n") < 2) | (F.col("connected") == 0)
    return rows.select("package", "modularity", F.when(none, 0.0).otherwise(F.col("divergence")).alias("divergence"), F.when(none, "matched").otherwise(F.col("direction")).alias("direction"), "connected", F.when(none, "no_signal").otherwise(verdict).alias("verdict"))


def module_edges(g: Graph, prefix: str | None = None, exclude_tests: bool = True) -> DataFrame:
    """source, target, kind: symbol edges lifted to the files that hold their ends; type-only ones are out."""
    files = g.nodes.where("type in ('FILE', 'MODULE') and namespace = 'INTERNAL'")
    by_path = files.groupBy("file_path").agg(F.max(F.struct((F.col("type") == "FILE").alias("f"), "id", "is_test")).alias("h")).select("file_path", F.col("h.id").alias("holder"), F.col("h.is_test").alias("test"))
    held = g.nodes.join(by_path, "file_path").select("id", "holder", "test")
    held = held.where(F.lit(not exclude_tests) | ~F.col("test"))
    held = held.where(under("holder", prefix)) if prefix else held
    kind = F.create_map(*[x for k, ts in LAYERS.items() for t in ts for x in (F.lit(t), F.lit(k))])
    e = g.edges.where("not type_only").select("source", "target", kind[F.col("type")].alias("kind")).where("kind is not null").distinct()
    s, t = held.select(F.col("id").alias("source"), F.col("holder").alias("a")), held.select(F.col("id").alias("target"), F.col("holder").alias("b"))
    return e.join(s, "source").join(t, "target").where("a <> b").select(F.col("a").alias("source"), F.col("b").alias("target"), "kind").distinct()


def transitive_reduction(edges: DataFrame, work: Workspace) -> DataFrame:
    """The edges (source, target) that no longer way implies; all edges within a cycle stay.

    Components of two and more are one node of the acyclic rest. An edge between two goes if the
    target's component is reached through a third.
    """
    edges = work.save(edges.select("source", "target").distinct())
    comp = work.save(strong_components(edges.select(F.col("source").alias("src"), F.col("target").alias("dst")), work).select("id", "component"))
    side = lambda c, n: comp.select(F.col("id").alias(c), F.col("component").alias(n))
    e = edges.join(side("source", "cs"), "source", "left").join(side("target", "ct"), "target", "left").select("source", "target", F.coalesce("cs", "source").alias("cs"), F.coalesce("ct", "target").alias("ct"))
    e = work.save(e)
    dag = work.save(e.where("cs <> ct").select(F.col("cs").alias("src"), F.col("ct").alias("dst")).distinct())
    implied = implied_links(dag, work).select(F.col("src").alias("cs"), F.col("dst").alias("ct"))
    return e.join(implied, ["cs", "ct"], "left_anti").select("source", "target")


def uncovered(kept: DataFrame, work: Workspace) -> DataFrame:
    """source, target, kind without the imports that a kept inheritance of the same pair stands for, unless on a cycle."""
    imports = kept.where("kind = 'imports'").select("source", "target")
    comp = strong_components(imports.select(F.col("source").alias("src"), F.col("target").alias("dst")), work)
    a, b = comp.select(F.col("id").alias("source"), F.col("component").alias("x")), comp.select(F.col("id").alias("target"), F.col("component").alias("y"))
    hidden = imports.join(kept.where("kind = 'extends'").select("source", "target"), ["source", "target"], "left_semi")
    hidden = hidden.join(a, "source", "left").join(b, "target", "left").where("x is null or y is null or x <> y").select("source", "target", F.lit("imports").alias("kind"))
    return kept.join(hidden, ["source", "target", "kind"], "left_anti")


#: A module graph of at most this many links is reduced in one task.
ONE_TASK_REDUCTION = 100_000


def _reduced_here(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links (src, dst) of an acyclic graph that a longer way implies, by bit sets of what each id reaches, ends first."""
    after: dict[str, list[str]] = {}
    for a, b in zip(pdf["src"], pdf["dst"]):
        after.setdefault(a, []).append(b)
    place, reach = {}, {}
    for root in after:
        trail = [(root, iter(after[root]))]
        while trail:
            x, rest = trail[-1]
            y = next((y for y in rest if y not in reach), None)
            if y is not None:
                trail.append((y, iter(after.get(y, ()))))
                continue
            trail.pop()
            if x not in reach:
                place[x] = len(place)
                reach[x] = 1 << place[x]
                for z in after.get(x, ()):
                    reach[x] |= reach[z]
    gone = []
    for a, near in after.items():
        for b in near:
            if any(c != b and reach[c] >> place[b] & 1 for c in near):
                gone.append((a, b))
    return pd.DataFrame(gone, columns=["src", "dst"])


def implied_links(dag: DataFrame, work: Workspace, one_task: int = ONE_TASK_REDUCTION) -> DataFrame:
    """src, dst: the links of an acyclic graph (src, dst, distinct) whose end is reached through a third id as well.

    A small graph takes one task. In a larger one each id gets its level, the longest way to an end. A link
    between neighbouring levels is not implied, and a way to a link's end can only pass levels
    between both: from the ends of the links that skip levels the search goes up, and not above them. What it holds are
    ids that lie between a skipping link's levels, not all pairs that are joined by a way.
    """
    if dag.count() <= one_task:
        kind = dict(dag.dtypes)["src"]
        return dag.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(_reduced_here, f"src {kind}, dst {kind}")
    front, n = work.save(dag.select(F.col("src").alias("id")).distinct()), 0
    levels = [dag.select(F.col("dst").alias("id")).distinct().withColumn("level", F.lit(0))]
    while front.take(1):
        n += 1
        levels.append(front.withColumn("level", F.lit(n)))
        front = work.save(dag.join(front.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct())
    every = levels[0]
    for x in levels[1:]:
        every = every.unionByName(x)
    level = work.save(every.groupBy("id").agg(F.max("level").alias("level")))
    at = lambda c, name: level.select(F.col("id").alias(c), F.col("level").alias(name))
    e = work.save(dag.join(at("src", "ls"), "src").join(at("dst", "ld"), "dst"))
    skips = work.save(e.where("ls > ld + 1"))
    top = work.save(skips.groupBy("dst").agg(F.max("ls").alias("top")).withColumnRenamed("dst", "end"))
    up = e.select(F.col("src").alias("above"), F.col("dst").alias("id"), F.col("ls").alias("level"))
    seen = front = work.save(top.join(up.withColumnRenamed("id", "end"), "end").where("level < top").select("end", F.col("above").alias("id"), "top"))
    while front.take(1):
        step = front.join(up, "id").where("level < top").select("end", F.col("above").alias("id"), "top").distinct()
        front = work.save(step.join(seen.select("end", "id"), ["end", "id"], "left_anti"))
        seen = seen.unionByName(front)
    via = e.select("src", F.col("dst").alias("id")).join(seen.select("end", "id"), "id").select("src", F.col("end").alias("dst"))
    return skips.select("src", "dst").join(via, ["src", "dst"], "left_semi")


def reduced_layers(edges: DataFrame, work: Workspace, one_task: int = ONE_TASK_REDUCTION) -> DataFrame:
    """source, target, kind of module edges after each kind is reduced by itself: links that a longer way of the kind implies are out.

    Components of two and more are one node of the acyclic rest; links within one stay, and those between
    two go or stay together.
    """
    out = None
    for kind in LAYERS:
        mine = work.save(edges.where(F.col("kind") == kind).select("source", "target").distinct())
        comp = work.save(strong_components(mine.select(F.col("source").alias("src"), F.col("target").alias("dst")), work).select("id", "component"))
        side = lambda c, n: comp.select(F.col("id").alias(c), F.col("component").alias(n))  # noqa: E731,B023
        e = work.save(mine.join(side("source", "cs"), "source", "left").join(side("target", "ct"), "target", "left").select("source", "target", F.coalesce("cs", "source").alias("cs"), F.coalesce("ct", "target").alias("ct")))
        dag = work.save(e.where("cs <> ct").select(F.col("cs").alias("src"), F.col("ct").alias("dst")).distinct())
        gone = implied_links(dag, work, one_task).select(F.col("src").alias("cs"), F.col("dst").alias("ct"))
        kept = e.join(gone, ["cs", "ct"], "left_anti").select("source", "target", F.lit(kind).alias("kind"))
        out = kept if out is None else out.unionByName(kept)
    return work.save(out)


@dataclass(frozen=True)
class ModuleGraph:
    """edges (source, target, kind), what the reduction dropped and inheritance covered (kind, dropped, covered), and
    outside (source, package): what members need of other packages."""

    edges: DataFrame
    counts: DataFrame
    outside: DataFrame


def module_graph(g: Graph, prefix: str, layers: tuple[str, ...] = ("imports", "extends"), reduce: bool = True, exclude_tests: bool = True, expand: bool = False) -> ModuleGraph:
    """The dependencies between the direct children of a package, or with ``expand`` between its modules.

    An edge of the code becomes one between the files that hold its ends; type-only ones are out, as are
    tests and the package's own file. Each layer is reduced by itself; then an import goes for which a kept inheritance of the same pair
    stands, unless it lies on a cycle of imports. With ``expand`` an import of a package through which only names of its modules
    are taken is not drawn.
    """
    if not layers or set(layers) - set(LAYERS):
        raise ValueError(f"layers are some of {list(LAYERS)}")
    work = g.work
    files = g.internal("FILE", "MODULE")
    by_path = work.save(files.groupBy("file_path").agg(F.max(F.struct((F.col("type") == "FILE").alias("f"), "id", "is_test")).alias("h")).select("file_path", F.col("h.id").alias("holder"), F.col("h.is_test").alias("test")))
    held = g.nodes.join(by_path, "file_path").select("id", "holder", "test")
    held = work.save(held.where(F.lit(not exclude_tests) | ~F.col("test")))
    kind = F.create_map(*[x for k in layers for t in LAYERS[k] for x in (F.lit(t), F.lit(k))])
    s, t = held.select(F.col("id").alias("source"), F.col("holder").alias("a")), held.select(F.col("id").alias("target"), F.col("holder").alias("b"))
    wanted = g.edges.where("not type_only").select("source", "target", "type", kind[F.col("type")].alias("kind")).where("kind is not null").distinct()
    # Sources first: few lie in the package, and only theirs meet the targets.
    inside = s.where(F.col("a").startswith(prefix + "."))
    ends = work.save(g.meet(g.meet(wanted, inside, "source"), t, "target").select("a", "b", "type", "kind").distinct())
    if expand:
        named = ends.where("type = 'IMPORTS_SYMBOL'").select("a", F.col("b").alias("through"))
        heads = F.transform(F.sequence(F.lit(1), F.size(F.split("through", "[.]")) - 1), lambda k: F.array_join(F.slice(F.split("through", "[.]"), 1, k), "."))
        passed = named.where(F.contains("through", F.lit("."))).select("a", F.explode(heads).alias("b"), F.lit("IMPORTS").alias("type")).distinct()
        ends = ends.join(passed, ["a", "b", "type"], "left_anti")
    packages = by_path.select(F.regexp_replace("holder", r"\.[^.]*$", "").alias("b")).where("b <> ''").join(by_path.select(F.col("holder").alias("b")), "b", "left_semi").distinct()
    out = ends.where(~under("b", prefix)).join(packages.withColumn("own", F.lit(True)), "b", "left")
    group = lambda c: F.col(c) if expand else direct_child(F.col(c), prefix)
    package = F.when(F.col("own") | ~F.contains("b", F.lit(".")), F.col("b")).otherwise(F.regexp_replace("b", r"\.[^.]*$", ""))
    outside = out.select(group("a").alias("source"), package.alias("package")).distinct()
    found = work.save(ends.where(F.col("b").startswith(prefix + ".")).select(group("a").alias("source"), group("b").alias("target"), "kind").where("source <> target").distinct())
    kept = reduced_layers(found, work) if reduce else found
    shown = work.save(uncovered(kept, work))
    n = lambda d, name: d.groupBy("kind").agg(F.count("*").alias(name))
    all_ = g.work.spark.createDataFrame([(k,) for k in layers], "kind string").join(n(found, "f"), "kind", "left").join(n(kept, "k"), "kind", "left").join(n(shown, "s"), "kind", "left").na.fill(0)
    return ModuleGraph(shown, all_.select("kind", (F.col("f") - F.col("k")).alias("dropped"), (F.col("k") - F.col("s")).alias("covered")), outside)


@dataclass(frozen=True)
class Suggestion:
    """How a package falls into communities: one row of figures, members (id, community), bridges (source, target, weight)."""

    verdict: DataFrame
    members: DataFrame
    bridges: DataFrame


def suggest_packages(g: Graph, prefix: str, with_calls: bool = False, min_q: float = 0.35, all_descendants: bool = False) -> Suggestion:
    """Should the direct children of a package, or with ``all_descendants`` all its files, be grouped anew.

    verdict: n_files, n_edges, modularity, divergence, direction, connected, verdict, note. A package without files, of a
    single member, or none of whose members are linked gives no_signal and says why. A split or
    borderline package of which under half the members are linked is left. Bridges are the links between communities, heaviest first.
    """
    work, spark = g.work, g.work.spark
    rows = "n_files int, n_edges int, modularity double, divergence double, direction string, connected double, verdict string, note string"
    none = lambda n, note: Suggestion(spark.createDataFrame([(n, 0, 0.0, 0.0, "matched", 0.0, "no_signal", note)], rows), spark.createDataFrame([], "id string, community string"), spark.createDataFrame([], "source string, target string, weight double"))
    prefix = (prefix or "").strip()
    if not prefix:
        return none(0, "no prefix")
    files = work.save(g.nodes.where("type in ('FILE', 'MODULE')").where(under("id", prefix)).select("id"))
    n_files = files.count()
    if n_files < 2:
        return none(n_files, "no files" if not n_files else "a single module")
    graph = work.save(file_graph(g, prefix, with_calls))
    linked_files = bool(graph.take(1))
    ids = files
    if not all_descendants:
        graph = work.save(children_graph(graph, prefix))
        ids = work.save(files.select(direct_child(F.col("id"), prefix).alias("id")).distinct())
    n = ids.count()
    if n < 2:
        return none(n, "a single child")
    if not graph.take(1):
        tried = g.typed("IMPORTS").where(under("source", prefix)).take(1)
        return none(n, "links stay inside sub-packages" if linked_files else "no import resolves inside" if tried else "no imports inside")
    found = work.save(communities(graph.withColumn("package", F.lit(prefix)), ids.withColumn("package", F.lit(prefix))))
    child = direct_child(F.col("id"), prefix)
    dirs = ids.where(child != F.col("id")).select(child.alias("directory")).distinct()
    grouped = found.withColumn("directory", child).join(F.broadcast(dirs.withColumn("own", F.lit(True))), "directory", "left").withColumn("directory", F.when(F.col("own"), F.col("directory")).otherwise("<root>")).drop("own")
    verdict = layout_verdicts(grouped, graph.withColumn("package", F.lit(prefix)), split=min_q)
    counts = graph.where("a < b").agg(F.count("*").cast("int").alias("n_edges"))
    sparse = F.when((F.col("verdict") == "leave") & (F.col("connected") < 0.5) & (F.col("modularity") >= 0.25) & (F.col("divergence") >= 0.2), F.lit("mostly unlinked members"))
    line = verdict.join(counts).select(F.lit(n).alias("n_files"), "n_edges", "modularity", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("divergence"))).alias("divergence"), "direction", "connected", "verdict", sparse.alias("note"))
    of = lambda c, name: found.select(F.col("id").alias(c), F.col("community").alias(name))
    bridges = graph.where("a < b").join(of("a", "ca"), "a").join(of("b", "cb"), "b").where("ca <> cb").select(F.col("a").alias("source"), F.col("b").alias("target"), "weight")
    return Suggestion(line, found.select("id", "community"), bridges.orderBy(F.desc("weight"), "source", "target"))
