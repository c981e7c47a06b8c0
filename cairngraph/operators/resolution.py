"""Names linked to symbols: suffixes, calls, classes of origin, overrides, method order."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairngraph.graph import Graph
from cairngraph.operators.skew import hot_keys, split_join
from cairngraph.operators.structure import suffixes
from cairngraph.operators.traversal import min_depths
from cairngraph.workspace import Workspace


def symbol_suffixes(g: Graph) -> DataFrame:
    """suffix, id: dotted tails that name one internal symbol alone."""
    s = suffixes(g.internal().select("id"), "id")
    return s.groupBy("suffix").agg(F.min("id").alias("id"), F.countDistinct("id").alias("n")).where("n = 1").drop("n")


def resolve_raw_calls(g: Graph) -> DataFrame:
    """edge_id, resolved, confidence of calls to bare names: the one symbol of that name in the caller's language, else in its file.

    Names no rule places keep a null ``resolved`` and confidence 0.8.
    """
    raw = g.typed("CALLS").where(F.col("target").startswith("raw_call:")).select(F.col("id").alias("edge_id"), "source", F.substr("target", F.lit(10)).alias("name"))
    callable_ = g.internal("FUNCTION", "METHOD", "CLASS").select("id", "name", "language", "file_path")
    callers = g.nodes.select(F.col("id").alias("source"), "language", "file_path")
    calls = g.meet(raw, callers, "source", "left")
    one = lambda *by: callable_.groupBy("name", *by).agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1").drop("n")
    whole = one("language").withColumnRenamed("id", "in_language")
    near = one("file_path").withColumnRenamed("id", "in_file")
    # A name that is called everywhere is a hot key of both joins; names are those of raw targets.
    hot = lambda c: hot_keys(calls.groupBy("name", c).agg(F.count("*").alias("n")), ["name", c]) if g.hot("target") else []
    out = split_join(split_join(calls, whole, ["name", "language"], "left", hot("language")), near, ["name", "file_path"], "left", hot("file_path"))
    found = F.coalesce("in_language", "in_file")
    return out.select("edge_id", found.alias("resolved"), F.when(found.isNotNull(), 1.0).otherwise(0.8).alias("confidence"))


def classify_targets(g: Graph) -> DataFrame:
    """namespace, n_targets of distinct edge targets: their node's, else INTERNAL by first-party root, else UNKNOWN."""
    roots = g.internal().select(F.substring_index("id", ".", 1).alias("root")).distinct()
    t = g.edges.select(F.col("target").alias("id")).distinct().join(g.nodes.select("id", "namespace"), "id", "left").withColumn("root", F.substring_index("id", ".", 1))
    t = t.join(roots.withColumn("own", F.lit(True)), "root", "left")
    space = F.coalesce("namespace", F.when(F.col("own"), F.lit("INTERNAL")), F.lit("UNKNOWN"))
    return t.groupBy(space.alias("namespace")).agg(F.count("*").alias("n_targets"))


def capped_confidence(g: Graph) -> DataFrame:
    """type, confidence, n of edges, no more than 0.8 into nodes of unknown origin."""
    e = g.meet(g.edges.select("type", "confidence", "target"), g.nodes.where("namespace = 'UNKNOWN'").select(F.col("id").alias("target"), F.lit(True).alias("unknown")), "target", "left")
    return e.groupBy("type", F.when(F.col("unknown"), F.least("confidence", F.lit(0.8))).otherwise(F.col("confidence")).alias("confidence")).agg(F.count("*").alias("n"))


def hierarchy_dispatch(g: Graph) -> DataFrame:
    """source, target: each method with the nearest definition of its name up its class's line, tests and dunders out.

    The ways up from every class are walked for all classes at once; of equally near definitions the
    least id counts.
    """
    methods = g.nodes.where("type = 'METHOD' and not is_test").select("id", F.regexp_replace("id", r"\.[^.]*$", "").alias("class"), "name").where(~(F.col("name").startswith("__") & F.col("name").endswith("__")))
    methods = g.work.save(methods)
    parents = g.work.save(g.typed("EXTENDS").select(F.col("source").alias("class"), F.col("target").alias("parent")).where("class <> parent").distinct())
    front = g.work.save(methods.join(parents, "class").select(F.col("id").alias("target"), "name", F.col("parent").alias("at")).distinct())
    seen, found = front, []
    own = methods.select(F.col("class").alias("at"), "name", F.col("id").alias("source"))
    while front.take(1):
        hit = g.work.save(front.join(own, ["at", "name"]).groupBy("target").agg(F.min("source").alias("source")))
        found.append(hit)
        up = front.join(hit.select("target"), "target", "left_anti").join(parents.withColumnRenamed("class", "at"), "at").select("target", "name", F.col("parent").alias("at")).distinct()
        front = g.work.save(up.join(seen, ["target", "name", "at"], "left_anti"))
        seen = seen.unionByName(front)
    out = found[0] if found else methods.select(F.col("id").alias("target"), F.col("id").alias("source")).where("false")
    for f in found[1:]:
        out = out.unionByName(f)
    return out.where("source <> target").select("source", "target")


def interface_dispatch(needs: DataFrame, has: DataFrame) -> DataFrame:
    """interface, type: types with every method (method, arity) an interface needs; a null arity fits any.

    An interface meets only the types that have the method of it which fewest types have; these are then
    counted over all its methods, so a name that every type has brings no pairs of its own.
    """
    total = needs.groupBy("interface").agg(F.countDistinct("method").alias("n"))
    spread = has.select("type", "method").distinct().groupBy("method").agg(F.count("*").alias("k"))
    rare = needs.select("interface", "method").distinct().join(spread, "method", "left").na.fill(0, ["k"]).groupBy("interface").agg(F.min_by("method", F.struct("k", "method")).alias("method"))
    near = rare.join(has.select("type", "method").distinct(), "method").select("interface", "type")
    own = has.withColumnRenamed("arity", "got")
    fit = near.join(needs, "interface").join(own, ["type", "method"]).where("arity is null or got is null or arity = got")
    return fit.groupBy("interface", "type").agg(F.countDistinct("method").alias("m")).join(total, "interface").where("m = n").select("interface", "type")


def ancestors(g: Graph, root: str) -> DataFrame:
    links = g.typed("EXTENDS").select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct()
    return min_depths(links, g.work.spark.createDataFrame([(root,)], "id string"), g.work).where("depth > 0")


def _merged(rows: list[list[str]]) -> list[str] | None:
    """C3's merge: again and again the first head that stands in no other row's rest; None where there is none.

    How often a name stands in a rest is counted, so a long line costs its length.
    """
    rows = [list(r) for r in rows if r]
    at = [0] * len(rows)
    rests = Counter(x for r in rows for x in r[1:])
    out: list[str] = []
    while True:
        open_ = [i for i, r in enumerate(rows) if at[i] < len(r)]
        if not open_:
            return out
        head = next((rows[i][at[i]] for i in open_ if not rests[rows[i][at[i]]]), None)
        if head is None:
            return None
        out.append(head)
        for i in open_:
            if rows[i][at[i]] == head:
                at[i] += 1
                if at[i] < len(rows[i]):
                    rests[rows[i][at[i]]] -= 1


def method_order(bases: DataFrame, work: Workspace) -> DataFrame:
    """class, nth, member: the C3 order of every class that has one, from (class, base, position).

    Bases stand in order of position. A class whose bases contradict each other, or that lies on or above
    a cycle, has no order and no rows; nor has one that extends such a class. Each round merges the orders of all classes whose bases have
    theirs: as many rounds as the deepest line has classes, and no task holds a hierarchy.
    """
    rows = bases.where("class is not null and base is not null").groupBy("class", "base").agg(F.min("position").alias("position"))
    links = work.save(rows)
    declared = work.save(links.groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "base"))), lambda x: x.base).alias("bases")))
    tops = links.select(F.col("base").alias("class")).distinct().join(declared.select("class"), "class", "left_anti")

    @F.pandas_udf("array<string>")
    def merge(cls: pd.Series, orders: pd.Series, own: pd.Series) -> pd.Series:
        found = []
        for c, above, named in zip(cls, orders, own):
            line = {o[0]: list(o) for o in (list(x) for x in above)}
            merged = _merged([*(line[b] for b in named), list(named)])
            found.append(None if merged is None else [c, *merged])
        return pd.Series(found, index=cls.index)

    done = work.save(tops.select("class", F.array("class").alias("line")))
    every, front = done, done
    waiting = work.save(declared.withColumn("n", F.size("bases")))
    while front.take(1):
        # Only what a new order could complete is looked at.
        asked = links.join(front.select(F.col("class").alias("base")), "base", "left_semi").select("class").distinct()
        ready = links.join(asked, "class", "left_semi").join(every.select(F.col("class").alias("base"), "line"), "base")
        ready = ready.groupBy("class").agg(F.collect_list("line").alias("lines")).join(waiting, "class").where(F.size("lines") == F.col("n"))
        front = work.save(ready.select("class", merge("class", "lines", "bases").alias("line")).where("line is not null"))
        every = every.unionByName(front)
    return every.select("class", F.posexplode("line").alias("nth", "member")).join(declared.select("class"), "class", "left_semi")


def reexports(forwards: DataFrame, work) -> DataFrame:
    """symbol, final: where a forwarded symbol (symbol, to) ends up after every hop; a cycle ends where it began to repeat."""
    state = work.save(forwards.select("symbol", "to").distinct().groupBy("symbol").agg(F.min("to").alias("to")))
    hops = state.select(F.col("symbol").alias("to"), F.col("to").alias("then"))
    rounds = max(1, state.count().bit_length())
    for _ in range(rounds):
        newer = work.save(state.join(hops, "to", "left").select("symbol", F.coalesce("then", "to").alias("to")))
        hops = newer.select(F.col("symbol").alias("to"), F.col("to").alias("then"))
        state = newer
    return state.select("symbol", F.col("to").alias("final"))


def first_by(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
