"""Triads, fingerprints, quotients and the distances between them."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairngraph.graph import Graph
from cairngraph.operators.components import strong_components
from cairngraph.operators.skew import extent, sized_join, split_join
from cairngraph.operators.storage import unresolved
from cairngraph.workspace import Workspace

# The thirteen connected triads.
TRIADS = "021D 021U 021C 111D 111U 030T 030C 201 120D 120U 120C 210 300".split()
# Pairs of each triad that point both ways.
MUTUAL = {"111D": 1, "111U": 1, "201": 2, "120D": 1, "120U": 1, "120C": 1, "210": 2, "300": 3}


def triad_name(code: int) -> str | None:
    """The class of the triple (v, u, w) whose links v-u, u-v, v-w, w-v, u-w, w-u are the bits of ``code`` from the lowest; None if not connected.

    Told from how many pairs are mutual, one-way and empty, and which way the one-way ones point.
    """
    links = {p for k, p in enumerate([("v", "u"), ("u", "v"), ("v", "w"), ("w", "v"), ("u", "w"), ("w", "u")]) if code >> k & 1}
    pairs = list(itertools.combinations("vuw", 2))
    mutual = [p for p in pairs if p in links and p[::-1] in links]
    one_way = [x for x in links if x[::-1] not in links]
    empty = 3 - len(mutual) - len(one_way)
    if empty > 1:
        return None
    outs = sorted(sum(a == x for a, _ in one_way) for x in "vuw")
    ins = sorted(sum(b == x for _, b in one_way) for x in "vuw")
    shape = f"{len(mutual)}{len(one_way)}{empty}"
    if shape == "021":
        return "021D" if outs[-1] == 2 else "021U" if ins[-1] == 2 else "021C"
    if shape == "111":
        return "111D" if one_way[0][1] in mutual[0] else "111U"
    if shape == "030":
        return "030C" if outs == [1, 1, 1] else "030T"
    if shape == "120":
        return "120D" if outs[-1] == 2 else "120U" if ins[-1] == 2 else "120C"
    return shape


def triad_census(links: DataFrame, by: str = "domain") -> DataFrame:
    """``by``, triad, n: connected triads of the directed links (``by``, src, dst), parallel links and loops out; zeros included.

    A pair of neighbours of one node is made once, at the end of least degree where it can be: what a
    hub's neighbours make of each other, n squared of them, is counted and not joined. Open triads at
    a node follow from how many links of each kind it has; closed ones are listed from triangles alone.
    """
    d = links.where("src <> dst").select(by, "src", "dst").distinct()
    back = d.select(by, F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("b"))
    # Dyads from both sides: k is 1 for a link away, 2 for one towards, 3 for both.
    side = d.withColumn("a", F.lit(1)).join(back, [by, "src", "dst"], "full").select(by, F.col("src").alias("x"), F.col("dst").alias("y"), (F.coalesce("a", F.lit(0)) + 2 * F.coalesce("b", F.lit(0))).alias("k"))
    kinds = [F.count(F.when(F.col("k") == k, 1)).alias(f"n{k}") for k in (1, 2, 3)]
    ends = side.groupBy(by, "x").agg(*kinds)
    pairs = []
    for i, j in itertools.combinations_with_replacement((1, 2, 3), 2):
        n = F.col(f"n{i}") * (F.col(f"n{i}") - 1) / 2 if i == j else F.col(f"n{i}") * F.col(f"n{j}")
        pairs.append(F.struct(F.lit(wedge_name(i, j)).alias("triad"), n.cast("long").alias("n")))
    wedges = ends.select(by, F.explode(F.array(*pairs)).alias("w")).groupBy(by, "w.triad").agg(F.sum("w.n").alias("n"))
    # Triangles, each once: links go from the end of lower degree to the other, and two that leave one node are joined.
    degree = side.groupBy(by, "x").agg(F.count("*").alias("deg"))
    dx, dy = degree.select(by, "x", F.col("deg").alias("px")), degree.select(by, F.col("x").alias("y"), F.col("deg").alias("py"))
    up = side.join(dx, [by, "x"]).join(dy, [by, "y"]).where((F.col("px") < F.col("py")) | ((F.col("px") == F.col("py")) & (F.col("x") < F.col("y")))).select(by, "x", "y", "k", "py")
    one = up.select(by, F.col("x").alias("v"), F.col("y").alias("u"), F.col("k").alias("kvu"), F.col("py").alias("pu"))
    two = up.select(by, F.col("x").alias("v"), F.col("y").alias("w"), F.col("k").alias("kvw"), F.col("py").alias("pw"))
    three = up.select(by, F.col("x").alias("u"), F.col("y").alias("w"), F.col("k").alias("kuw"))
    triangles = one.join(two, [by, "v"]).where((F.col("pu") < F.col("pw")) | ((F.col("pu") == F.col("pw")) & (F.col("u") < F.col("w")))).join(three, [by, "u", "w"])
    closed = triangles.groupBy(by, "kvu", "kvw", "kuw").agg(F.count("*").alias("n"))
    names = F.create_map(*[x for c in itertools.product((1, 2, 3), repeat=3) for x in (F.lit("".join(map(str, c))), F.lit(triad_name(c[0] + 4 * c[1] + 16 * c[2])))])
    full = closed.select(by, names[F.concat("kvu", "kvw", "kuw")].alias("triad"), "n")
    # A triangle holds three of the wedges that were counted as open.
    taken = [F.struct(names_of_wedges("kvu", "kvw", "kuw", at).alias("triad"), (-F.col("n")).alias("n")) for at in range(3)]
    counts = wedges.unionByName(full).unionByName(closed.select(by, F.explode(F.array(*taken)).alias("w")).select(by, "w.triad", "w.n"))
    zeros = links.select(by).distinct().select(by, F.explode(F.array(*[F.lit(t) for t in TRIADS])).alias("triad"), F.lit(0).cast("long").alias("n"))
    return counts.unionByName(zeros).groupBy(by, "triad").agg(F.sum("n").alias("n"))


def wedge_name(i: int, j: int) -> str:
    """The open triad of a node with dyads of kinds i and j and no link between the other two."""
    return triad_name(i + 4 * j)


def names_of_wedges(vu: str, vw: str, uw: str, at: int) -> Column:
    """The wedge of a triangle at its node v, u or w; a dyad seen from its other end has its ways exchanged."""
    turn = lambda c: F.when(F.col(c) == 3, 3).otherwise(3 - F.col(c))
    i, j = [(F.col(vu), F.col(vw)), (turn(vu), F.col(uw)), (turn(vw), turn(uw))][at]
    table = F.create_map(*[x for a, b in itertools.product((1, 2, 3), repeat=2) for x in (F.lit(a * 10 + b), F.lit(wedge_name(a, b)))])
    return table[(i * 10 + j).cast("int")]


def domain_links(g: Graph, kind: str, depth: int = 1) -> DataFrame:
    """domain (first ``depth`` parts), src, dst of edges of a type within one domain, both ends being nodes."""
    top = lambda c: F.substring_index(c, ".", depth)
    e = g.typed(kind).select(F.col("source").alias("src"), F.col("target").alias("dst")).where(top("src") == top("dst"))
    ids = lambda c: g.nodes.select(F.col("id").alias(c))
    e = split_join(split_join(e, ids("src"), ["src"], "left_semi", g.hot("source")), ids("dst"), ["dst"], "left_semi", g.hot("target"))
    return e.select(top("src").alias("domain"), "src", "dst")


def normalized(census: DataFrame) -> DataFrame:
    """domain, triad, share: all zero where there are no triads."""
    total = census.groupBy("domain").agg(F.sum("n").alias("total"))
    return census.join(total, "domain").select("domain", "triad", F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(0.0).alias("share"))


def tangle_mass(shares: DataFrame) -> DataFrame:
    """domain, tangle: share of pairs that point both ways, among the pairs of triads."""
    weight = F.create_map(*[x for t in TRIADS for x in (F.lit(t), F.lit(MUTUAL.get(t, 0)))])
    return shares.groupBy("domain").agg((F.sum(F.col("share") * weight[F.col("triad")]) / 3).alias("tangle"))


def tangle_ratio(imports: DataFrame, calls: DataFrame, unresolved: DataFrame) -> DataFrame:
    """domain, tangle_ratio for each domain of ``unresolved``: the greater tangle of both layers' shares, that of calls fading with unresolved_ratio; 0 without triads."""
    ti, tc = tangle_mass(imports).withColumnRenamed("tangle", "ti"), tangle_mass(calls).withColumnRenamed("tangle", "tc")
    rows = unresolved.select("domain", "unresolved_ratio").join(ti, "domain", "left").join(tc, "domain", "left").na.fill(0.0, ["ti", "tc"])
    keep = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("unresolved_ratio")))
    return rows.select("domain", F.greatest("ti", keep * F.col("tc")).alias("tangle_ratio"))


def tv_distance(shares: DataFrame, ideals: DataFrame) -> DataFrame:
    """domain, template, distance: half the summed differences between a domain's shares and a template's (template, triad, share)."""
    ideal = ideals.select("template", "triad", F.col("share").alias("ideal"))
    both = shares.join(F.broadcast(ideal), "triad")  # templates are a few dozen settings
    return both.groupBy("domain", "template").agg((F.sum(F.abs(F.col("share") - F.col("ideal"))) / 2).alias("distance"))


def fingerprint_counters(g: Graph, depth: int = 1, hub: int = 2, star: int = 3, router: int = 2) -> DataFrame:
    """domain, n_nodes, hubs, stars, routers, unresolved_ratio of each top package."""
    top = lambda c: F.substring_index(c, ".", depth)
    nodes = g.nodes.select("id", top("id").alias("domain"))
    calls = domain_links(g, "CALLS", depth)
    into = calls.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))
    out = calls.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("fan_out"))
    every = g.typed("CALLS").select("source", "target")
    total = every.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("all_out"))
    importers = g.typed("IMPORTS").select(F.col("target").alias("source"), F.col("source").alias("target")).distinct()
    met = every.join(importers, ["source", "target"], "left_semi").select(F.col("source").alias("id"), F.lit(True).alias("met")).distinct()
    space = g.nodes.select(F.col("id").alias("target"), F.col("namespace").alias("target_namespace"))
    bad = g.meet(every, space, "target", "left").groupBy(F.col("source").alias("id")).agg(F.count(F.when(unresolved(), 1)).alias("bad"))
    rows = nodes.join(into, "id", "left").join(out, "id", "left").join(total, "id", "left").join(met, "id", "left").join(bad, "id", "left").na.fill(0)
    count = lambda c: F.count(F.when(c, 1))
    out_ = rows.groupBy("domain").agg(F.count("*").alias("n_nodes"), count((F.col("fan_in") > hub) & (F.col("fan_out") == 0)).alias("hubs"), count((F.col("fan_out") > star) & (F.col("fan_in") <= 1)).alias("stars"), count((F.col("all_out") > router) & F.col("met").isNull()).alias("routers"), F.sum("bad").alias("bad"), F.sum("all_out").alias("calls"))
    return out_.select("domain", "n_nodes", "hubs", "stars", "routers", F.when(F.col("calls") > 0, F.col("bad") / F.col("calls")).otherwise(0.0).alias("unresolved_ratio"))


def cycle_ratio(g: Graph, depth: int = 1) -> DataFrame:
    """domain, cycle_ratio: share of its nodes that live in files on an import cycle within it."""
    top = lambda c: F.substring_index(c, ".", depth)
    files = g.nodes.where("type in ('FILE', 'MODULE')").select("id")
    e = g.typed("IMPORTS").where("not type_only").select(F.col("source").alias("src"), F.col("target").alias("dst")).where(top("src") == top("dst"))
    e = e.join(files.withColumnRenamed("id", "src"), "src", "left_semi").join(files.withColumnRenamed("id", "dst"), "dst", "left_semi")
    cyclic = strong_components(e, g.work).select("id")
    nodes = g.nodes.select("id", "file_path", top("id").alias("domain"))
    paths = nodes.join(cyclic, "id", "left_semi").select("domain", "file_path", F.lit(1).alias("hit")).distinct()
    return nodes.join(paths, ["domain", "file_path"], "left").groupBy("domain").agg((F.count("hit") / F.count("*")).alias("cycle_ratio"))


def longest_ways(links: DataFrame, g: Graph) -> DataFrame:
    """domain, src, length: the longest way from each root (a source that is no target), by rounds.

    Links within a cycle lead nowhere new and are not walked.
    """
    links = g.work.save(links.where("src <> dst").select("domain", "src", "dst").distinct())
    comp = strong_components(links.select("src", "dst"), g.work)
    a, b = comp.select(F.col("id").alias("src"), F.col("component").alias("x")), comp.select(F.col("id").alias("dst"), F.col("component").alias("y"))
    roots = links.select("domain", "src").join(links.select("domain", F.col("dst").alias("src")), ["domain", "src"], "left_anti").distinct()
    links = g.work.save(links.join(a, "src", "left").join(b, "dst", "left").where("x is null or y is null or x <> y").select("domain", "src", "dst"))
    # A round takes one link more, from the ends backwards, and holds a node once whatever ways lead on from it.
    front, n = g.work.save(links.select("domain", "src").distinct()), 1
    found = roots.select("domain", "src", F.lit(0).alias("length"))
    while front.take(1):
        found = found.unionByName(front.join(roots, ["domain", "src"], "left_semi").withColumn("length", F.lit(n)))
        n += 1
        front = g.work.save(links.join(front.select("domain", F.col("src").alias("dst")), ["domain", "dst"], "left_semi").select("domain", "src").distinct())
    return found.groupBy("domain", "src").agg(F.max("length").alias("length"))


def root_depths(links: DataFrame, work: Workspace) -> DataFrame:
    """domain, src, length: the longest way from each root (a source that no link, its own included, leads to).

    Each cycle is one node, so a way goes in at one of its members and on from another. A round takes
    one link more, from the ends backwards, and holds a node once whatever ways lead on from it.
    """
    links = work.save(links.select("domain", "src", "dst").distinct())
    # Domains may lie within each other, so an id is told apart by its domain.
    tag = lambda c: F.concat("domain", F.lit("\x1f"), c)
    comp = strong_components(links.select(tag("src").alias("src"), tag("dst").alias("dst")), work)
    comp = comp.select(F.substring_index("id", "\x1f", 1).alias("domain"), F.substring_index("id", "\x1f", -1).alias("id"), F.substring_index("component", "\x1f", -1).alias("component"))
    a, b = comp.select("domain", F.col("id").alias("src"), F.col("component").alias("x")), comp.select("domain", F.col("id").alias("dst"), F.col("component").alias("y"))
    dag = links.join(a, ["domain", "src"], "left").join(b, ["domain", "dst"], "left").select("domain", F.coalesce("x", "src").alias("x"), F.coalesce("y", "dst").alias("y"))
    dag = work.save(dag.where("x <> y").distinct())
    roots = links.select("domain", "src").distinct().join(links.select("domain", F.col("dst").alias("src")).distinct(), ["domain", "src"], "left_anti")
    front, n = work.save(dag.select("domain", "x").distinct()), 1
    found = front.withColumn("length", F.lit(n))
    while front.take(1):
        n += 1
        front = work.save(dag.join(front.withColumnRenamed("x", "y"), ["domain", "y"], "left_semi").select("domain", "x").distinct())
        found = found.unionByName(front.withColumn("length", F.lit(n)))
    return roots.join(found.withColumnRenamed("x", "src"), ["domain", "src"]).groupBy("domain", "src").agg(F.max("length").alias("length"))


def fingerprint(g: Graph, depth: int = 1) -> DataFrame:
    """The counters of each top package with chain_len, the mean of its roots' longest ways along calls, and dag_depth, the longest along imports; 0 without roots."""
    chains = root_depths(domain_links(g, "CALLS", depth), g.work).groupBy("domain").agg(F.avg("length").alias("chain_len"))
    depths = root_depths(domain_links(g, "IMPORTS", depth), g.work).groupBy("domain").agg(F.max("length").alias("dag_depth"))
    return fingerprint_counters(g, depth).join(chains, "domain", "left").join(depths, "domain", "left").na.fill(0, ["chain_len", "dag_depth"])


def quotient_edges(g: Graph, depth: int = 1) -> DataFrame:
    """source, target, type, weight: imports and calls between the top packages of internal nodes."""
    top = lambda c: F.substring_index(c, ".", depth)
    inside = g.internal().select("id")
    e = g.typed("IMPORTS", "CALLS").select("source", "target", "type")
    e = g.meet(g.meet(e, inside.withColumnRenamed("id", "source"), "source", "left_semi"), inside.withColumnRenamed("id", "target"), "target", "left_semi")
    return e.groupBy(top("source").alias("source"), top("target").alias("target"), "type").agg(F.count("*").alias("weight")).where("source <> target")


def assign_domains(ids: DataFrame, prefixes: DataFrame, work: Workspace) -> DataFrame:
    """id, domain: the longest prefix (domain, prefix) an id is or lies under, by joining its own heads.

    Spark takes the heads to be no more than the ids and would broadcast them all; only the prefixes may be, as measured.
    """
    parts = F.split("id", "[.]")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    prefixes = work.save(prefixes)
    size = extent(prefixes)
    # Beyond the bound the hint keeps either side from being broadcast by its estimate; up to it, sized_join's own goes first.
    found = sized_join(ids.select("id", F.explode(heads).alias("prefix")), prefixes.hint("merge"), ["prefix"], "inner", size)
    return found.groupBy("id").agg(F.max_by("domain", F.length("prefix")).alias("domain"))


def call_tally(g: Graph, depth: int = 1) -> DataFrame:
    """domain, unresolved, total calls that leave internal nodes."""
    space = g.nodes.select(F.col("id").alias("target"), F.col("namespace").alias("target_namespace"))
    e = g.meet(g.meet(g.typed("CALLS").select("source", "target"), g.internal().select(F.col("id").alias("source")), "source", "left_semi"), space, "target", "left")
    return e.groupBy(F.substring_index("source", ".", depth).alias("domain")).agg(F.count(F.when(unresolved(), 1)).alias("unresolved"), F.count("*").alias("total"))


def tier_ladder(g: Graph, kind: str = "CALLS", rungs: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """rung, n_groups, n_triads, entropy (bits) of the triad census at each coarsening: ids cut to their first parts."""
    inside = g.internal().select("id")
    e = g.typed(kind).select("source", "target").join(inside.withColumnRenamed("id", "source"), "source", "left_semi").join(inside.withColumnRenamed("id", "target"), "target", "left_semi")
    cut = [F.struct(F.lit(r).alias("domain"), F.substring_index("source", ".", r).alias("src"), F.substring_index("target", ".", r).alias("dst")) for r in rungs]
    links = g.work.save(e.select(F.explode(F.array(*cut)).alias("l")).select("l.*").where("src <> dst").distinct())
    groups = links.select("domain", F.explode(F.array("src", "dst")).alias("x")).groupBy("domain").agg(F.countDistinct("x").alias("n_groups"))
    shares = normalized(triad_census(links))
    bits = shares.where("share > 0").groupBy("domain").agg(F.sum(-F.col("share") * F.log2("share")).alias("entropy"))
    triads = triad_census(links).groupBy("domain").agg(F.sum("n").alias("n_triads"))
    return groups.join(triads, "domain").join(bits, "domain", "left").select(F.col("domain").alias("rung"), "n_groups", "n_triads", F.coalesce("entropy", F.lit(0.0)).alias("entropy"))


def entropy_fit(ladder: DataFrame, least: int = 10) -> DataFrame:
    """One row: slope, r2, points of entropy on -log2 of the groups, over rungs with enough triads and more than one group."""
    x = -F.log2("n_groups")
    live = ladder.where((F.col("n_triads") >= least) & (F.col("n_groups") > 1)).select(x.alias("x"), "entropy")
    return live.agg(F.regr_slope("entropy", "x").alias("slope"), F.regr_r2("entropy", "x").alias("r2"), F.count("*").alias("points"))


def structural_groups(g: Graph) -> DataFrame:
    """id, class, file, dirs: each node's group at the symbol's class and at its file, and the directories of that file.

    The nearest one going up by containment, the node itself included; a node with none is its own
    group. Ways up double each round until none moves; a way that never ends finds none.
    """
    nodes = g.nodes.select("id", "type", "file_path")
    up = g.typed("CONTAINS", "DECLARES").select(F.col("target").alias("id"), F.col("source").alias("parent")).join(nodes.select(F.col("id").alias("parent")), "parent", "left_semi").groupBy("id").agg(F.min("parent").alias("parent"))
    above = F.coalesce("parent", "id")
    is_file = F.col("type").isin("FILE", "MODULE")
    ways = g.work.save(nodes.join(up, "id", "left").select("id", F.when(is_file | (F.col("type") == "CLASS"), F.col("id")).otherwise(above).alias("c"), F.when(is_file, F.col("id")).otherwise(above).alias("f")))
    for _ in range(ways.count().bit_length()):
        far_c, far_f = ways.select(F.col("id").alias("c"), F.col("c").alias("c2")), ways.select(F.col("id").alias("f"), F.col("f").alias("f2"))
        newer = g.work.save(ways.join(far_c, "c").join(far_f, "f").select("id", F.col("c2").alias("c"), F.col("f2").alias("f"), ((F.col("c") != F.col("c2")) | (F.col("f") != F.col("f2"))).alias("moved")))
        moved = newer.where("moved").take(1)
        ways = newer.drop("moved")
        if not moved:
            break
    kinds = nodes.select(F.col("id").alias("c"), F.col("type").alias("ct")), nodes.select(F.col("id").alias("f"), F.col("type").alias("ft"))
    found = nodes.join(ways, "id").join(kinds[0], "c").join(kinds[1], "f")
    symbol = F.col("type").isin("FUNCTION", "METHOD", "VARIABLE")
    cls = F.when(symbol & F.col("ct").isin("FILE", "MODULE", "CLASS"), F.col("c")).otherwise(F.col("id"))
    found = found.select("id", cls.alias("class"), F.when(F.col("ft").isin("FILE", "MODULE"), F.col("f")).otherwise(F.col("id")).alias("file"))
    parts = F.split(F.coalesce("file_path", F.lit("")), "/")
    dirs = nodes.select(F.col("id").alias("file"), F.slice(parts, F.lit(1), F.size(parts) - 1).alias("dirs"))
    return g.work.save(found.join(dirs, "file").select("id", "class", "file", "dirs"))


def structural_ladder(g: Graph) -> DataFrame:
    """layer, rung, name, n_groups, n_triads, entropy (bits, null without triads) of imports and of calls.

    Rungs from the finest: symbol, class, module, then directories cut from the leaf, one part more a
    rung, to the root. Groups without links count. A rung whose census is that of the one before is left out.
    """
    groups = structural_groups(g)
    deepest = groups.agg(F.max(F.size("dirs"))).first()[0] or 0
    names = ["T0_symbol", "T1_class", "T2_module", *(f"T{k + 2}_up{k}" for k in range(1, deepest + 1))]
    cut = lambda k: F.array_join(F.slice("dirs", F.lit(1), F.greatest(F.size("dirs") - k + 1, F.lit(0))), "/")
    ups = [F.when(cut(k) == "", "<root>").otherwise(cut(k)) for k in range(1, deepest + 1)]
    rungs = g.work.save(groups.select("id", F.array(F.col("id"), F.col("class"), F.col("file"), *ups).alias("g")))
    sizes = rungs.select(F.posexplode("g").alias("rung", "x")).distinct().groupBy("rung").agg(F.count("*").alias("n_groups"))
    e = g.typed("IMPORTS", "CALLS").select("type", "source", "target").distinct()
    e = e.join(rungs.select(F.col("id").alias("source"), F.col("g").alias("a")), "source").join(rungs.select(F.col("id").alias("target"), F.col("g").alias("b")), "target")
    pairs = e.select("type", F.posexplode(F.arrays_zip("a", "b")).alias("rung", "p")).select(F.struct("type", "rung").alias("domain"), F.col("p.a").alias("src"), F.col("p.b").alias("dst"))
    census = g.work.save(triad_census(g.work.save(pairs.where("src <> dst").distinct())))
    total = census.groupBy("domain").agg(F.sum("n").alias("n_triads"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.concat_ws(":", "triad", "n")))), ",").alias("census"))
    share = F.col("n") / F.col("n_triads")
    bits = census.where("n > 0").join(total, "domain").groupBy("domain").agg(F.sum(-share * F.log2(share)).alias("entropy"))
    measured = total.join(bits, "domain", "left").select(F.col("domain.type").alias("layer"), F.col("domain.rung").alias("rung"), "n_triads", "census", "entropy")
    every = sizes.withColumn("layer", F.explode(F.array(F.lit("IMPORTS"), F.lit("CALLS"))))
    rows = every.join(measured, ["layer", "rung"], "left").na.fill({"n_triads": 0, "census": ""})
    before = F.lag("census").over(Window.partitionBy("layer").orderBy("rung"))  # as many rows as rungs
    rows = rows.withColumn("before", before).where("before is null or before <> census")
    return rows.select("layer", "rung", F.array(*map(F.lit, names))[F.col("rung")].alias("name"), "n_groups", "n_triads", "entropy")


def ladder_fit(ladder: DataFrame, least: int = 10) -> DataFrame:
    """layer, slope, r2, std_error, points, verdict: entropy on -log2 of the groups over live rungs.

    Fewer than three live rungs, or rungs of one size, give nulls and no_signal; a slope within two
    standard errors is scale_invariant, one above hierarchical, one below flat.
    """
    live = (F.col("n_triads") >= least) & (F.col("n_groups") > 1)
    x, y = F.when(live, -F.log2("n_groups")), F.when(live, F.col("entropy"))
    sums = ladder.groupBy("layer").agg(F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.count(y).alias("points"))
    fits = (F.col("points") >= 3) & (F.col("sxx") >= 1e-12)
    slope = F.col("sxy") / F.col("sxx")
    res = F.greatest(F.lit(0.0), F.col("syy") - slope * F.col("sxy"))
    rows = sums.select("layer", F.when(fits, slope).alias("slope"), F.when(fits, F.when(F.col("syy") > 1e-12, 1 - res / F.col("syy")).otherwise(0.0)).alias("r2"), F.when(fits, F.sqrt(res / (F.col("points") - 2) / F.col("sxx"))).alias("std_error"), "points")
    band = 2 * F.col("std_error")
    return rows.withColumn("verdict", F.when(F.col("slope").isNull(), "no_signal").when(F.col("slope") > band, "hierarchical").when(F.col("slope") < -band, "flat").otherwise("scale_invariant"))
