"""python -m cairngraph COMMAND FOLDER ...: the operators over a graph directory, answers as text or JSON lines.

On a cluster: spark-submit with this file; the session there is the cluster's own.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairngraph.graph import Graph
from cairngraph.operators import diffcheck, lookup, metrics, motifs, storage, structure, traversal
from cairngraph.operators import drift_run as drift
from cairngraph.sources import sinks
from cairngraph.workspace import shared_folder

# What each command takes where nothing is said.
DEPTH, STRUCTURE_DEPTH, UNRESOLVED, DRIFT, LIMIT, MIN_Q, CAP = 5, 2, 0.30, 0.50, 10, 0.35, 5


def show(df: DataFrame, a: argparse.Namespace) -> None:
    """Rows as JSON lines, at most ``--rows``; that many and no more come to the driver."""
    for line in df.limit(a.rows).toJSON().toLocalIterator():
        print(line)


def named(g: Graph, a: argparse.Namespace) -> str:
    """The id a name stands for; what else it could be is said, and the command ends."""
    row = lookup.resolve_names(g, g.work.spark.createDataFrame([(a.name,)], "name string"), a.root or []).first()
    if row["resolved"] is None:
        sys.exit(f"{a.name}: " + ("one of " + ", ".join(row["candidates"]) if row["candidates"] else "no such symbol"))
    return row["resolved"]


def prefix_of(g: Graph, a: argparse.Namespace) -> str:
    return lookup.effective_prefixes(g, g.work.spark.createDataFrame([(a.name,)], "prefix string"), a.root or []).first()["effective"]


def walked(g: Graph, a: argparse.Namespace, upstream: bool) -> None:
    root = named(g, a)
    w = traversal.walk(g, [root], upstream, a.depth, floor=a.min_confidence, hide_tests=not a.tests, internal_only=not a.external, budget=a.budget)
    show(w.reached.orderBy("depth", "id"), a)
    if w.omitted:
        print(json.dumps({"omitted": w.omitted, "at_depth": w.cut_at}))
    if upstream:
        show(traversal.upstream_coverage(g, w.reached), a)


def validate(g: Graph, a: argparse.Namespace) -> None:
    stats = storage.edge_stats(g)
    show(stats, a)
    show(storage.top_unresolved(g), a)
    if stats.first()["unresolved_ratio"] > a.threshold:
        sys.exit(1)


def drifted(g: Graph, a: argparse.Namespace) -> None:
    with open(a.patterns, encoding="utf-8") as f:
        run = drift.drift_run(g, drift.Catalog.of(f.read()), a.max_drift, a.profile)
    show(run.reports, a)
    show(run.coverage.select(F.col("prefix").alias("uncovered")), a)
    if run.failed.first()[0]:
        sys.exit(1)


def checked(g: Graph, a: argparse.Namespace) -> None:
    spark = g.work.spark
    lines = diffcheck.parse_diffs(spark.read.text(a.diff, wholetext=True).withColumnRenamed("value", "diff"))
    base = spark.read.parquet(a.base) if a.base else g.nodes
    found = diffcheck.diff_check(g, lines, base, cap=a.cap)
    show(found.items.orderBy("nth"), a)
    show(found.summary, a)


def structured(g: Graph, a: argparse.Namespace) -> None:
    root = prefix_of(g, a)
    if lookup.is_package(g, root):
        files = storage.files_under(g, root).select(structure.direct_child(F.col("id"), root).alias("id")).distinct()
        show(files.orderBy("id"), a)
    else:
        a.name = root
        show(traversal.structure(g, named(g, a), a.depth).orderBy("depth", "id"), a)


def suggested(g: Graph, a: argparse.Namespace) -> None:
    s = structure.suggest_packages(g, prefix_of(g, a), a.calls, a.min_q, a.all_descendants)
    for part in (s.verdict, s.members, s.bridges):
        show(part, a)


def modules(g: Graph, a: argparse.Namespace) -> None:
    m = structure.module_graph(g, prefix_of(g, a), tuple(a.layer or ("imports", "extends")), not a.whole, not a.tests, a.expand)
    if a.mermaid:
        print(sinks.mermaid(m.edges.withColumnRenamed("kind", "type"), a.rows))
        return
    for part in (m.edges, m.counts, m.outside):
        show(part, a)


def context(g: Graph, a: argparse.Namespace) -> None:
    root = named(g, a)
    owner, members = lookup.class_context(g, root)
    show(g.nodes.where(F.col("id") == root), a)
    show(owner.select(F.col("id").alias("class")), a)
    show(members.select(F.col("id").alias("sibling")), a)
    for upstream, name in ((True, "caller"), (False, "callee")):
        reached = traversal.walk(g, [root], upstream, a.depth, ["CALLS"], internal_only=True, dispatch=False).reached.where(F.col("id") != root)
        show(reached.join(g.nodes.select("id", "file_path", "start_line"), "id").orderBy("file_path", "start_line", "id").select(F.col("id").alias(name), "depth"), a)


def audited(g: Graph, a: argparse.Namespace) -> None:
    sources = g.internal().where(lookup.in_scope("id", a.scope)).where(F.col("type").isin("FUNCTION", "METHOD"))
    show(traversal.reachability_audit(g, sources, [named(g, a)], a.depth).where("not covered"), a)


def export(g: Graph, a: argparse.Namespace) -> None:
    health = metrics.health(g).drop("depth")
    sinks.write_json(g.nodes.join(health, "id", "left"), g.edges, a.out)


COMMANDS: dict[str, tuple[Callable, tuple[str, ...]]] = {
    "overview": (lambda g, a: show(lookup.overview_packages(g), a), ()),
    "validate": (validate, ("threshold",)),
    "find": (lambda g, a: show(storage.symbol_search(g, a.name, tuple(a.kind or ()), limit=a.rows), a), ("name", "kind")),
    "resolve": (lambda g, a: print(named(g, a)), ("name",)),
    "impact": (lambda g, a: walked(g, a, True), ("name", "walk")),
    "trace": (lambda g, a: walked(g, a, False), ("name", "walk")),
    "structure": (structured, ("name", "depth")),
    "context": (context, ("name", "depth")),
    "metrics": (lambda g, a: show(lookup.architecture_report(g, a.exclude or (), a.scope or ()), a), ("scope",)),
    "analyze": (lambda g, a: [show(d, a) for d in (metrics.cycle_report(metrics.import_cycles(g)), metrics.zone_of_pain(g), metrics.god_objects(g))], ()),
    "orphans": (lambda g, a: show(metrics.orphan_classes(g).where(lookup.in_scope("id", a.scope)), a), ("scope",)),
    "audit": (audited, ("name", "depth", "scope")),
    "suggest-packages": (suggested, ("name", "suggest")),
    "module-graph": (modules, ("name", "modules")),
    "drift": (drifted, ("drift",)),
    "init-ontology": (lambda g, a: show(drift.propose(g, drift.domain_discovery(g.nodes), drift.Catalog()), a), ()),
    "fractal": (lambda g, a: [show(d, a) for d in (motifs.structural_ladder(g), motifs.ladder_fit(motifs.structural_ladder(g)))], ()),
    "diff-check": (checked, ("diff",)),
    "export": (export, ("out",)),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cairngraph", description="Questions about a graph directory (nodes.parquet, edges.parquet).")
    subs = top.add_subparsers(dest="command", required=True)
    for name, (_, wants) in COMMANDS.items():
        p = subs.add_parser(name)
        p.add_argument("folder")
        if "name" in wants:
            p.add_argument("name")
        p.add_argument("--rows", type=int, default=LIMIT * 10)
        p.add_argument("--root", action="append", help="a directory above the graph that names may begin with")
        if "walk" in wants or "depth" in wants:
            p.add_argument("--depth", type=int, default=STRUCTURE_DEPTH if name == "structure" else 1 if name == "context" else DEPTH)
        if "walk" in wants:
            p.add_argument("--min-confidence", type=float, default=0.0)
            p.add_argument("--tests", action="store_true")
            p.add_argument("--external", action="store_true")
            p.add_argument("--budget", type=int)
        if "kind" in wants:
            p.add_argument("--kind", action="append")
        if "scope" in wants:
            p.add_argument("--scope", action="append")
            p.add_argument("--exclude", action="append")
        if "threshold" in wants:
            p.add_argument("--threshold", type=float, default=UNRESOLVED)
        if "suggest" in wants:
            p.add_argument("--calls", action="store_true")
            p.add_argument("--all-descendants", action="store_true")
            p.add_argument("--min-q", type=float, default=MIN_Q)
        if "modules" in wants:
            p.add_argument("--layer", action="append")
            for flag in ("--whole", "--tests", "--expand", "--mermaid"):
                p.add_argument(flag, action="store_true")
        if "drift" in wants:
            p.add_argument("patterns", help="a JSON file of patterns, profiles, limits and bindings")
            p.add_argument("--max-drift", type=float, default=DRIFT)
            p.add_argument("--profile")
        if "diff" in wants:
            p.add_argument("diff", help="a unified diff")
            p.add_argument("--base", help="Parquet of the changed files' nodes as they were; the graph's own by default")
            p.add_argument("--cap", type=int, default=CAP)
        if "out" in wants:
            p.add_argument("out")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    if spark is None:
        from cairngraph.session import local_session

        spark = SparkSession.getActiveSession() or local_session()
    shared_folder(spark)  # fails early where a cluster names no folder
    COMMANDS[a.command][0](Graph.load(spark, a.folder), a)


if __name__ == "__main__":
    main()
