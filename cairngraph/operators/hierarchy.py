"""Parent-child links to root, depth, path and descendants, with chains that never end exposed.

Leaves are peeled while that shrinks the tree geometrically; what cannot be peeled further holds the
cycles and the long chains. Its Euler tour, a linked list of an entry and an exit for each node, is
ranked by pointer doubling: as many rounds as the list's length has bits, however deep the tree. The
peeled levels are then hung back on. An interval of entry and exit within its root holds exactly a
node's descendants.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairngraph.functions.text import trimmed, upper_word
from cairngraph.operators.skew import ROWS_PER_SALT, extent, hot_keys, salted_prefix, sized_join, split_join
from cairngraph.workspace import Workspace

#: Peeling goes on while a round takes at least this share of what is left.
PEEL_SHARE = 0.25


def parent_links(edges: DataFrame) -> DataFrame:
    """hierarchy, node, parent from CONTAINS and DECLARES (source is the parent) and EXTENDS (target is).

    Null ends make no link. Should a node have several parents in a hierarchy, the least counts.
    """
    kind = upper_word("type")
    down = kind.isin("CONTAINS", "DECLARES")
    rows = edges.where(down | (kind == "EXTENDS")).select(F.when(down, "containment").otherwise("inheritance").alias("hierarchy"), F.when(down, trimmed("target")).otherwise(trimmed("source")).alias("node"), F.when(down, trimmed("source")).otherwise(trimmed("target")).alias("parent"))
    rows = rows.where("node is not null and parent is not null")
    return rows.distinct().groupBy("hierarchy", "node").agg(F.min("parent").alias("parent"))


def _numbered(links: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """links with numbers, and the dictionary of numbers (no, hierarchy, name).

    Numbers are 64-bit hashes; names whose hashes meet, of 10^10 names some three, get the numbers
    from the least long on instead, which no hash of the table has.
    """
    number = F.xxhash64(F.lit("hierarchy"), "hierarchy", "name")
    ends = links.select("hierarchy", F.explode(F.array("node", "parent")).alias("name"))
    names = work.save(ends.groupBy("hierarchy", "name").agg(F.lit(1).alias("_")).select(number.alias("no"), "hierarchy", "name"))
    met = names.groupBy("no").count().where("count > 1").select("no")
    hash_of = lambda c: F.xxhash64(F.lit("hierarchy"), "hierarchy", c)
    if not met.take(1):
        return links.select(hash_of("node").alias("no"), hash_of("parent").alias("up")), names
    return _renumbered(links, names, work.save(names.join(met, "no", "left_semi")), work)


def _renumbered(links: DataFrame, names: DataFrame, met: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Numbers where the hashes of the names in ``met``, a handful, meet: those count up from the least long."""
    places = met.count()
    held = names.join(met, ["hierarchy", "name"], "left_anti")
    span = places
    while True:
        free = work.save(work.spark.range(span).select((F.lit(-(1 << 63)) + F.col("id")).alias("no")).join(held, "no", "left_anti"))
        if free.count() >= places:
            break
        span *= 2
    in_order = lambda d, order, name: d.withColumn(name, F.row_number().over(Window.orderBy(*order)))
    own = in_order(met.select("hierarchy", "name"), ["hierarchy", "name"], "_k").join(in_order(free, ["no"], "_k"), "_k").select("no", "hierarchy", "name")
    own = work.save(own)
    every = work.save(held.select("no", "hierarchy", "name").unionByName(own))
    fixed = lambda c, n: F.broadcast(own.select("hierarchy", F.col("name").alias(c), F.col("no").alias(n)))
    both = links.join(fixed("node", "_n"), ["hierarchy", "node"], "left").join(fixed("parent", "_p"), ["hierarchy", "parent"], "left")
    hash_of = lambda c: F.xxhash64(F.lit("hierarchy"), "hierarchy", c)
    return both.select(F.coalesce("_n", hash_of("node")).alias("no"), F.coalesce("_p", hash_of("parent")).alias("up")), every


def _rank(tour: DataFrame, work: Workspace) -> DataFrame:
    """elem, last, width, rise: the sums from each element to the end of its list, null ``last`` if it has none.

    Pointer doubling: after k rounds an element has summed 2^k others. ``next`` is null at an end. A list
    that ends has elements at every distance from its end, and each round settles those up to twice as
    far: once a round settles none, only closed lists, the cycles, are left.
    """
    state = work.save(tour.select("elem", F.coalesce("next", "elem").alias("at"), F.col("next").isNull().alias("over"), F.when(F.col("next").isNotNull(), F.col("width")).otherwise(0).alias("width"), F.when(F.col("next").isNotNull(), F.col("rise")).otherwise(0).alias("rise")))
    left = -1
    while True:
        ahead = state.select(F.col("elem").alias("at"), F.col("at").alias("then"), F.col("over").alias("ends"), F.col("width").alias("w"), F.col("rise").alias("r"))
        going, still = state.where("not over"), state.where("over")
        step = going.join(ahead, "at").select("elem", F.col("then").alias("at"), F.col("ends").alias("over"), (F.col("width") + F.col("w")).alias("width"), (F.col("rise") + F.col("r")).alias("rise"))
        newer = work.save(still.unionByName(step))
        work.drop(state)
        state = newer
        before, left = left, state.where("not over").count()
        if left in (0, before):
            break
    return state.select("elem", F.when(F.col("over"), F.col("at")).alias("last"), "width", "rise")


def forest(links: DataFrame, work: Workspace) -> DataFrame:
    """no, up, root, depth, entry, exit for each number that has a parent or is one (from ``no``, ``up``, ``no`` unique).

    Roots have null ``up``, depth 0 and entry 0. Chains that never end, and all that hangs on them,
    have null root, depth -1 and null entry. Descendants of x: same root, x.entry < entry < x.exit.
    """
    links = work.save(links)
    ups = links.groupBy("up").agg(F.count("*").alias("children"))
    nodes = links.join(ups.withColumnRenamed("up", "no"), "no", "full").select("no", "up", F.coalesce("children", F.lit(0)).alias("children"), F.lit(1).cast("long").alias("size"))
    left = work.save(nodes)
    n = links.count()
    peeled = []
    while n:
        leaves = left.where("children = 0 and up is not null")
        placed = work.save(salted_prefix(leaves.select("no", "up", "size"), "up", "no", F.col("size"), n))
        taken = placed.count()
        if taken < PEEL_SHARE * n:
            break
        sums = placed.groupBy("up").agg(F.sum("size").alias("more"), F.count("*").alias("gone")).withColumnRenamed("up", "no")
        rest = left.where("children > 0 or up is null").join(sums, "no", "left")
        newer = work.save(rest.select("no", "up", (F.col("children") - F.coalesce("gone", F.lit(0))).alias("children"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), F.col("size").alias("held")))
        # A leaf starts behind what its parent held before this round. Parents with very many leaves are joined where the leaves are.
        held = newer.select(F.col("no").alias("up"), "held")
        hot = hot_keys(sums.select(F.col("no").alias("up"), F.col("gone").alias("n")), ["up"], taken) if taken > ROWS_PER_SALT else []
        peeled.append((work.save(split_join(placed, held, ["up"], "inner", hot).select("no", "up", "size", (F.col("prefix") + F.col("held")).alias("offset"))), hot))
        work.drop(placed)
        left, n = newer, n - taken
    # The Euler tour of the rest. Element 2k is the entry of node k, 2k + 1 its exit; numbers may be any longs, so a pair says it.
    core = left.select("no", "up", "size")
    spread = work.save(salted_prefix(core.where("up is not null"), "up", "no", F.lit(1), n).select("no", "up", "place"))
    entry, exit_ = (lambda c: F.struct(F.col(c).alias("k"), F.lit(False).alias("out"))), (lambda c: F.struct(F.col(c).alias("k"), F.lit(True).alias("out")))
    first = spread.where("place = 0").select(F.col("up").alias("no"), F.col("no").alias("child"))
    follow = spread.select(F.col("up"), (F.col("place") - 1).alias("place"), F.col("no").alias("sibling"))
    ins = core.join(first, "no", "left").select(entry("no").alias("elem"), F.when(F.col("child").isNotNull(), entry("child")).otherwise(exit_("no")).alias("next"), F.col("size").alias("width"), F.lit(1).cast("long").alias("rise"))
    outs = spread.join(follow, ["up", "place"], "left").select(exit_("no").alias("elem"), F.when(F.col("sibling").isNotNull(), entry("sibling")).otherwise(exit_("up")).alias("next"), F.lit(0).cast("long").alias("width"), F.lit(-1).cast("long").alias("rise"))
    ends = core.where("up is null").select(exit_("no").alias("elem"), F.lit(None).cast("struct<k:bigint,out:boolean>").alias("next"), F.lit(0).cast("long").alias("width"), F.lit(0).cast("long").alias("rise"))
    ranked = _rank(ins.unionByName(outs).unionByName(ends), work)
    # An entry's sums run to its root's exit: the width behind it, and as many rises as falls but for its depth.
    at = ranked.groupBy("elem.k").agg(F.max("last.k").alias("root"), F.max(F.when(~F.col("elem.out"), F.col("width"))).alias("behind"), F.max(F.when(F.col("elem.out"), F.col("width"))).alias("after"), F.max(F.when(~F.col("elem.out"), F.col("rise"))).alias("rise")).withColumnRenamed("k", "no")
    done = work.save(core.join(at, "no"))
    roots = work.save(done.where("up is null").select("root", F.col("behind").alias("all")))
    done = sized_join(done, roots, ["root"], "left", extent(roots), big_rows=n + 1)
    ends_well = F.col("root").isNotNull()
    parts = [work.save(done.select("no", "up", "root", F.when(ends_well, 1 - F.col("rise")).otherwise(-1).cast("int").alias("depth"), F.when(ends_well, F.col("all") - F.col("behind")).alias("entry"), F.when(ends_well, F.col("all") - F.col("after")).alias("exit")))]
    for level, hot in reversed(peeled):
        above = parts[0]
        for p in parts[1:]:
            above = above.unionByName(p)
        parents = above.select(F.col("no").alias("up"), "root", F.col("depth").alias("above"), F.col("entry").alias("start"))
        start = F.col("start") + F.col("offset")
        parts.append(work.save(split_join(level, parents, ["up"], "inner", hot).select("no", "up", "root", F.when(F.col("above") < 0, -1).otherwise(F.col("above") + 1).cast("int").alias("depth"), start.alias("entry"), (start + F.col("size")).alias("exit"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def node_hierarchies(edges: DataFrame, work: Workspace) -> DataFrame:
    """hierarchy, node_id, root_id, depth, entry, exit, n_descendants for every id of a hierarchy, roots included.

    ``root_id`` is '' and depth -1 where the way up never ends, a node that is its own parent
    included; entry, exit and n_descendants are null there. No links give no rows.
    """
    links, names = _numbered(work.save(parent_links(edges)), work)
    found = work.save(forest(links, work).join(names, "no"))
    roots = work.save(found.where("up is null").select(F.col("no").alias("root"), F.col("name").alias("root_id")))
    out = sized_join(found, roots, ["root"], "left", extent(roots))
    return out.select("hierarchy", F.col("name").alias("node_id"), F.coalesce("root_id", F.lit("")).alias("root_id"), "depth", "entry", "exit", (F.col("exit") - F.col("entry") - 1).alias("n_descendants"), F.col("up").isNotNull().alias("has_parent"))


def node_paths(edges: DataFrame, work: Workspace, separator: str = "/") -> DataFrame:
    """hierarchy, node_id, path: the ids from the root down to the node, by doubling the known part of the way.

    Chains that never end have a null path.
    """
    every = work.save(node_hierarchies(edges, work).select("hierarchy", "node_id", "depth"))
    tree = every.where("depth >= 0")
    links = parent_links(edges).withColumnRenamed("node", "node_id")
    ways = tree.join(links, ["hierarchy", "node_id"], "left").select("hierarchy", "node_id", "depth", F.col("parent").alias("at"), F.array("node_id").alias("way"))
    ways = work.save(ways)
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    for _ in range(deepest.bit_length()):
        ahead = ways.select("hierarchy", F.col("node_id").alias("at"), F.col("at").alias("then"), F.col("way").alias("more"))
        newer = work.save(ways.join(ahead, ["hierarchy", "at"], "left").select("hierarchy", "node_id", "depth", F.col("then").alias("at"), F.when(F.col("more").isNotNull(), F.concat("more", "way")).otherwise(F.col("way")).alias("way")))
        work.drop(ways)
        ways = newer
    endless = every.where("depth < 0").select("hierarchy", "node_id", F.lit(None).cast("string").alias("path"))
    return ways.select("hierarchy", "node_id", F.array_join("way", separator).alias("path")).unionByName(endless)


def descendant_pairs(intervals: DataFrame) -> DataFrame:
    """hierarchy, node_id, descendant_id from the intervals (hierarchy, node_id, root_id, depth, entry, exit).

    As many rows as the depths sum up to. An interval of one place has no descendants. The others are cut
    into aligned blocks of a power of two of places, at most two of each width, and an entry meets, of
    each width its tree has, only the one block it lies in: no join compares all nodes of a tree.
    """
    tree = intervals.where("depth >= 0")
    width = tree.agg(F.max(F.col("exit") - F.col("entry"))).first()[0] or 1
    a, b = F.col("entry") + 1, F.col("exit")
    # At width 2^k the blocks that 2^(k+1) does not take: one at the left end, one at the right.
    cuts, none = [], F.array().cast("array<bigint>")
    for k in range(int(width).bit_length()):
        w = 1 << k
        lo, hi = F.ceil(a / w).cast("long"), F.floor(b / w).cast("long")
        up, down = F.ceil(a / (2 * w)).cast("long") * 2, F.floor(b / (2 * w)).cast("long") * 2
        whole = up >= down
        left = F.when(lo < hi, F.when(whole, F.sequence(lo, hi - 1)).otherwise(F.concat(F.when(lo < up, F.array(lo)).otherwise(none), F.when(down < hi, F.array(down)).otherwise(none)))).otherwise(none)
        cuts.append(F.transform(left, lambda x: F.struct(F.lit(k).alias("k"), x.alias("block"))))  # noqa: B023
    above = tree.where("exit - entry > 1").select("hierarchy", "root_id", "node_id", F.explode(F.flatten(F.array(*cuts))).alias("c")).select("hierarchy", "root_id", "node_id", "c.k", "c.block")
    sizes = above.select("k").distinct()
    at = tree.select("hierarchy", "root_id", F.col("node_id").alias("descendant_id"), "entry").join(F.broadcast(sizes))
    at = at.withColumn("block", F.expr("shiftright(entry, k)"))
    return above.join(at, ["hierarchy", "root_id", "k", "block"]).select("hierarchy", "node_id", "descendant_id")
