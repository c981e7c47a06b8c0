"""Walks over the graph, level by level."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairngraph.graph import Graph
from cairngraph.operators.skew import BROADCAST_BYTES, extent, sized_join, split_join
from cairngraph.schema import BEHAVIORAL, ENFORCEMENT, STRUCTURAL
from cairngraph.workspace import Workspace


def min_depths(links: DataFrame, roots: DataFrame, work: Workspace, limit: int | None = None, owner: bool = False) -> DataFrame:
    """id, depth and, with ``owner``, the least root at that depth, of all that src -> dst links reach from ``roots`` (id).

    Where no id has two ways in and there is no limit, ids look up instead: pointers to what is above
    double each round, so deep trees take few. Else levels are walked down. Both give the same.
    """
    if limit is None and not links.groupBy("dst").count().where("count > 1").take(1):
        return _nearest_above(links, roots, work, owner)
    first = roots.select("id").distinct().select("id", F.lit(0).alias("depth"), F.col("id").alias("owner"))
    seen = work.save(first)
    front, depth = seen, 0
    n = front.count()
    while n and (limit is None or depth < limit):
        depth += 1
        step = sized_join(links.withColumnRenamed("src", "id"), front.select("id", "owner"), ["id"], "inner", extent(front.select("id", "owner")))
        reached = step.groupBy(F.col("dst").alias("id")).agg(F.min("owner").alias("owner")).join(seen, "id", "left_anti")
        front = work.save(reached.select("id", F.lit(depth).alias("depth"), "owner"))
        n = front.count()
        seen = seen.unionByName(front)
    return seen if owner else seen.drop("owner")


def _nearest_above(links: DataFrame, roots: DataFrame, work: Workspace, owner: bool) -> DataFrame:
    marks = roots.select("id").distinct().withColumn("hit", F.lit(True))
    ids = links.select(F.col("dst").alias("id"), F.col("src").alias("at")).join(marks, "id", "full")
    hit = F.coalesce("hit", F.lit(False))
    state = work.save(ids.select("id", F.when(hit, F.col("id")).otherwise(F.col("at")).alias("at"), F.when(hit, 0).otherwise(1).alias("depth"), hit.alias("hit")))
    left = -1
    while True:
        ahead = state.select(F.col("id").alias("at"), F.col("at").alias("then"), F.col("depth").alias("more"), F.col("hit").alias("ends"))
        done = state.where("hit")
        going = state.where("not hit").join(ahead, "at").select("id", F.col("then").alias("at"), (F.col("depth") + F.col("more")).cast("int").alias("depth"), F.col("ends").alias("hit"))
        newer = work.save(done.unionByName(going))
        work.drop(state)
        state = newer
        # A way up that ends has ids at every distance, and each round settles those up to twice as far:
        # once a round settles none, only cycles are left.
        before, left = left, state.where("not hit").count()
        if left in (0, before):
            break
    found = state.where("hit").select("id", "depth", F.col("at").alias("owner"))
    return found if owner else found.drop("owner")


@dataclass(frozen=True)
class Walk:
    """reached: id, depth. edges: ids of the edges walked. omitted: how many ids the budget cut off, at which depth."""

    reached: DataFrame
    edges: DataFrame
    omitted: int = 0
    cut_at: int | None = None


def walk(g: Graph, roots: list[str], upstream: bool, depth: int, types: list[str] | None = None, floor: float = 0.0, hide_tests: bool = False, internal_only: bool = False, budget: int | None = None, dispatch: bool = True) -> Walk:
    """A bounded walk from ``roots``: against the edges if ``upstream``, else along them.

    Each level, the first included, is closed over DISPATCHES without spending depth. Files are not
    walked through unless they are roots. ``floor`` is the least confidence. With a ``budget`` a level
    that does not fit is cut by (outside code, file, id), and the walk ends. ``hide_tests`` hides none if a root is a
    test, and a walk with a budget goes through files if a root is one.
    """
    types = [t for t in (types or BEHAVIORAL) if t != "DISPATCHES"]
    here, there = ("target", "source") if upstream else ("source", "target")
    ok = g.edges.where(F.coalesce("confidence", F.lit(1.0)) >= floor)
    rows = lambda kinds: ok.where(F.col("type").isin(*kinds)).select("id", F.col(here).alias("at"), F.col(there).alias("next"))
    plain, sent = rows(types), rows(["DISPATCHES"])
    info = g.nodes.select(F.col("id").alias("next"), "is_test", "namespace", "type")
    own = g.nodes.where(F.col("id").isin(*roots)).agg(F.max(F.coalesce("is_test", F.lit(False))), F.max(F.col("type") == "FILE")).first()
    hide_tests, through_files = hide_tests and not own[0], bool(own[1]) and budget is not None
    work, spark = g.work, g.work.spark
    seen = spark.createDataFrame([(r, 0, False) for r in roots], "node string, depth int, leaf boolean")
    front, n_front, n_seen, walked = seen, len(roots), len(roots), []
    omitted, cut_at = 0, None

    def admit(edges: DataFrame, front: DataFrame, n_front: int, level: int) -> tuple[DataFrame, int]:
        nonlocal omitted, cut_at, seen, n_seen
        at = front.where("not leaf").select(F.col("node").alias("at"))
        small = n_front * 1024 <= BROADCAST_BYTES or extent(at).bytes <= BROADCAST_BYTES
        fetched = work.save(edges.join(F.broadcast(at), "at") if small else split_join(edges, at, ["at"], "inner", g.hot(here)))
        walked.append(fetched)
        new = fetched.select("next").distinct().join(seen.select(F.col("node").alias("next")), "next", "left_anti").join(info, "next", "left")
        if hide_tests:
            new = new.where("not coalesce(is_test, false)")
        if internal_only:
            new = new.where("namespace = 'INTERNAL'")
        new = work.save(new.select(F.col("next").alias("node"), F.lit(level).alias("depth"), ((F.coalesce("type", F.lit("")) == "FILE") & F.lit(not through_files)).alias("leaf"), (F.coalesce("namespace", F.lit("")) != "INTERNAL").alias("outside")))
        n = new.count()
        if budget is not None and n > (room := max(budget - n_seen, 0)):
            omitted, cut_at = n - room, level
            new, n = work.save(new.orderBy("outside", "leaf", "node").limit(room)), room
        new = new.drop("outside")
        if n:
            seen, n_seen = seen.unionByName(new), n_seen + n
        return new, n

    for level in range(depth + 1):
        if level:
            front, n_front = admit(plain, front, n_front, level)
        inner, n_inner = front, n_front
        while dispatch and cut_at is None and n_inner:
            inner, n_inner = admit(sent.where("at <> next"), inner, n_inner, level)
            if n_inner:
                front, n_front = front.unionByName(inner), n_front + n_inner
        if cut_at is not None or not n_front:
            break
    edges = spark.createDataFrame([], "id string, at string, next string")
    for w in walked:
        edges = edges.unionByName(w.select("id", "at", "next"))
    edges = edges.join(seen.select(F.col("node").alias("next")), "next", "left_semi").select("id").distinct()
    return Walk(seen.select(F.col("node").alias("id"), "depth"), edges, omitted, cut_at)


def upstream_coverage(g: Graph, reached: DataFrame) -> DataFrame:
    """One row: path_calls into what was reached, and hidden_calls of unknown nodes that share its names."""
    inside = reached.join(g.nodes, "id").where("namespace = 'INTERNAL' and type in ('FUNCTION', 'METHOD', 'CLASS')").select("id", "name")
    calls = g.typed("CALLS").select("source", "target")
    path = g.meet(calls, inside.select(F.col("id").alias("target")), "target", "left_semi").agg(F.count("*").alias("path_calls"))
    unknown = g.nodes.where("namespace = 'UNKNOWN'").join(inside.select("name").distinct(), "name", "left_semi").select(F.col("id").alias("target"))
    raw = inside.select(F.concat(F.lit("raw_call:"), "name").alias("target")).distinct()
    hidden = g.meet(calls, unknown.unionByName(raw).distinct(), "target", "left_semi").agg(F.count("*").alias("hidden_calls"))
    return path.join(hidden)


def reachability_audit(g: Graph, sources: DataFrame, targets: list[str], depth: int = 5) -> DataFrame:
    """id, covered: whether each source reaches one of ``targets`` over enforcing edges; one walk against them serves all."""
    reached = walk(g, targets, True, depth, ENFORCEMENT, dispatch=True).reached
    return sources.select("id").distinct().join(reached.select("id", F.lit(True).alias("covered")), "id", "left").na.fill(False, ["covered"])


def subclasses(g: Graph, root: str, depth: int = 10) -> DataFrame:
    """id, depth of the classes that extend ``root``, directly or not."""
    links = g.typed("EXTENDS").select(F.col("target").alias("src"), F.col("source").alias("dst")).distinct()
    return min_depths(links, g.work.spark.createDataFrame([(root,)], "id string"), g.work, depth).where("depth > 0")


def structure(g: Graph, root: str, depth: int) -> DataFrame:
    """id, depth of what ``root`` contains or declares."""
    links = g.typed(*STRUCTURAL).select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct()
    return min_depths(links, g.work.spark.createDataFrame([(root,)], "id string"), g.work, depth)


def propagate_labels(g: Graph, labels: DataFrame) -> DataFrame:
    """id, label: labels (id, label) handed down to all that is contained or declared below.

    Where no id has two places above it, each round every id looks twice as far up, and deep trees take few
    rounds. Else labels go down a level a round, each id taking a label once; what is held is never more than the result.
    """
    links = g.work.save(g.typed(*STRUCTURAL).select(F.col("target").alias("id"), F.col("source").alias("up")).where("id <> up").distinct())
    seen = g.work.save(labels.select("id", "label").distinct())
    if links.groupBy("id").count().where("count > 1").take(1):
        front = seen
        while front.take(1):
            got = links.join(front.select(F.col("id").alias("up"), "label"), "up").select("id", "label").distinct()
            front = g.work.save(got.join(seen, ["id", "label"], "left_anti"))
            seen = seen.unionByName(front)
        return seen
    ways = links
    # After as many rounds as the number of links has bits, the farthest way up is known; cycles only repeat.
    for _ in range(links.count().bit_length() + 1):
        got = ways.join(seen.select(F.col("id").alias("up"), "label"), "up").select("id", "label")
        seen = g.work.save(seen.unionByName(got).distinct())
        newer = g.work.save(ways.join(ways.select(F.col("id").alias("up"), F.col("up").alias("top")), "up").select("id", F.col("top").alias("up")).distinct())
        g.work.drop(ways)
        ways = newer
        if not ways.take(1):
            break
    return seen
