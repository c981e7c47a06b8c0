"""Drift of bound packages: fingerprints, scores, gates, fits, the quotient of all, and what no binding covers."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairngraph.graph import Graph
from cairngraph.operators.components import strong_components
from cairngraph.operators.drift import CALLS_LAYER, GOOD_FIT, HYGIENE, MAX_RESIDUAL, TEMPLATES, WARNING_BAND, constraints, domain_discovery, relaxed_bounds
from cairngraph.operators.motifs import MUTUAL, TRIADS, normalized, root_depths, triad_census
from cairngraph.operators.resolution import reexports
from cairngraph.operators.skew import split_join
from cairngraph.schema import RAW_CALL
from cairngraph.workspace import Workspace

# The bounds templates set besides their shape, and their parameters.
TEMPLATE_BOUNDS = {"pure_utility": {"unresolved_ratio": {"max": 0.1}}, "layered_dag": {"dag_depth": {"min": "$min_depth"}}}
TEMPLATE_PARAMS = {"layered_dag": {"min_depth": 3.0}}
# What bounds and layers weigh in each profile.
PROFILES = {
    "python": {
        "weights": {"hub_count": 0.15, "star_count": 0.15, "chain_len": 0.10, "dag_depth": 0.10, "router_count": 0.10, "cycle_ratio": 0.25, "unresolved_ratio": 0.15},
        "layers": {"imports": 0.35, "calls": 0.35, "gates": 0.30},
    },
    "typescript": {
        "weights": {"hub_count": 0.10, "star_count": 0.10, "chain_len": 0.10, "dag_depth": 0.15, "router_count": 0.10, "cycle_ratio": 0.30, "unresolved_ratio": 0.15},
        "layers": {"imports": 0.45, "calls": 0.25, "gates": 0.30},
    },
}
# Fan-in of a hub, fan-out of a star and of a router that are exceeded; the quotient's prefix; the proposal's limit and margins.
HUB, STAR, ROUTER = 2, 3, 2
QUOTIENT = "quotient"
NO_FIT, MARGIN, MIN_NODES = 0.5, 0.03, 10
MEASURES = ["hub_count", "star_count", "chain_len", "dag_depth", "router_count", "cycle_ratio", "unresolved_ratio", "tangle_ratio"]


@dataclass(frozen=True)
class Binding:
    """What a package is expected to look like. Without a pattern or profile only its bounds count; ``enforce`` says whether it can fail the run."""

    name: str
    prefix: str
    pattern: str | None = None
    tolerance: float | None = None
    profile: str | None = None
    params: dict[str, float] = field(default_factory=dict)
    baseline: dict[str, float] = field(default_factory=dict)
    enforce: bool = True


@dataclass(frozen=True)
class Catalog:
    """Templates' shapes and bounds, profiles, limits for all, and bindings of packages and of the quotient."""

    templates: dict[str, dict[str, dict[str, float]]] = field(default_factory=lambda: {n: {"imports": s, "calls": s} for n, s in TEMPLATES.items()})
    bounds: dict[str, dict[str, dict[str, object]]] = field(default_factory=lambda: TEMPLATE_BOUNDS)
    params: dict[str, dict[str, float]] = field(default_factory=lambda: TEMPLATE_PARAMS)
    profiles: dict[str, dict[str, dict[str, float]]] = field(default_factory=lambda: PROFILES)
    hygiene: dict[str, tuple[str, float]] = field(default_factory=lambda: HYGIENE)
    domains: tuple[Binding, ...] = ()
    levels: tuple[Binding, ...] = ()

    def __post_init__(self) -> None:
        for b in (*self.domains, *self.levels):
            if set(b.baseline) - set(self.hygiene):
                raise ValueError(f"{b.name}: a baseline names no limit: {sorted(set(b.baseline) - set(self.hygiene))}")
            if b.profile is not None and b.profile not in self.profiles:
                raise ValueError(f"{b.name}: no profile {b.profile}")
            if set(b.params) - set(self.params.get(b.pattern, {})):
                raise ValueError(f"{b.name}: parameters its pattern does not declare")
        for n, layers in self.templates.items():
            for shape in layers.values():
                if set(shape) - set(TRIADS) or abs(sum(shape.values()) - 1) > 1e-9:
                    raise ValueError(f"{n}: an ideal is shares of known triads that sum up to 1")

    @classmethod
    def of(cls, text: str) -> Catalog:
        """From JSON: patterns (ideal, params, bounds by name), profiles (drift_weights, layers, triad_weights), hygiene, project_domains, project_level."""
        raw = json.loads(text)
        patterns = raw.get("patterns") or {}
        known = set(MEASURES)
        binding = lambda d, enforce: Binding(d["name"], d["fqn_prefix"], d.get("expected_pattern"), d.get("drift_tolerance"), d.get("profile"), {k: float(v) for k, v in (d.get("params") or {}).items()}, {k: float(v) for k, v in (d.get("hygiene_baseline") or {}).items()}, bool(d.get("enforce", enforce)))
        return cls(
            {n: p["ideal"] for n, p in patterns.items() if p.get("ideal")},
            {n: {k: v for k, v in p.items() if k in known} for n, p in patterns.items()},
            {n: p.get("params") or {} for n, p in patterns.items()},
            {n: {"weights": p.get("drift_weights") or {}, "layers": p.get("layers"), "triad_weights": p.get("triad_weights") or {}} for n, p in (raw.get("profiles") or {}).items()},
            constraints(raw.get("hygiene") or {}, {}),
            tuple(binding(d, True) for d in raw.get("project_domains") or []),
            tuple(binding(d, False) for d in raw.get("project_level") or []),
        )

    def scored_bounds(self, b: Binding) -> dict[str, tuple[str, float]]:
        """The limits for all, overlaid by the pattern's."""
        own = constraints(self.bounds.get(b.pattern, {}), {**self.params.get(b.pattern, {}), **b.params}) if b.pattern else {}
        return {**self.hygiene, **own}


def members_of(nodes: DataFrame, prefixes: Iterable[str]) -> DataFrame:
    """domain (the prefix), id: every node under each prefix, at a dot; prefixes may lie within each other. They are a few settings."""
    asked = sorted(set(prefixes))
    parts = F.split("id", "[.]")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))
    return nodes.select("id", F.explode(heads).alias("domain")).where(F.col("domain").isin(*asked) if asked else F.lit(False)).select("domain", "id")


def _looked_through(nodes: DataFrame, edges: DataFrame, members: DataFrame, imports: DataFrame, work: Workspace) -> DataFrame:
    """Imports of each domain (domain, src, dst) and those that names forwarded by a module of it hide: the importer and the module that has the name."""
    forwards = nodes.select("id", F.from_json(F.get_json_object("metadata", "$.reexports"), "map<string,string>").alias("f")).where("f is not null")
    if not forwards.take(1):
        return imports
    tag = lambda d, c: F.concat(d, F.lit("\x1f"), c)
    own = members.join(forwards, "id").select("domain", "id", F.explode("f").alias("name", "to"))
    final = reexports(own.select(tag(F.col("domain"), F.concat("id", F.lit("."), "name")).alias("symbol"), tag(F.col("domain"), F.col("to")).alias("to")), work)
    taken = edges.where("type = 'IMPORTS_SYMBOL'").select(F.col("source").alias("id"), "target").join(members, "id").select("domain", F.col("id").alias("src"), tag(F.col("domain"), F.col("target")).alias("symbol"))
    found = taken.join(final, "symbol").select("domain", "src", F.substring_index("final", "\x1f", -1).alias("symbol"))
    parts = F.split("symbol", "[.]")
    heads = found.select("domain", "src", "symbol", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))).alias("dst"))
    modules = members.join(nodes.where("type in ('FILE', 'MODULE')").select("id"), "id", "left_semi").select("domain", F.col("id").alias("dst"))
    owner = heads.join(modules, ["domain", "dst"], "left_semi").groupBy("domain", "src", "symbol").agg(F.max_by("dst", F.length("dst")).alias("dst"))
    return imports.unionByName(owner.where("src <> dst").select("domain", "src", "dst")).distinct()


def fingerprints(nodes: DataFrame, edges: DataFrame, members: DataFrame, work: Workspace, tally: DataFrame | None = None, hot: tuple[list[int], list[int]] = ([], [])) -> DataFrame:
    """domain, node_count, edge_count, the measures (MEASURES) and t_imports, t_calls (triad to share) of each domain of ``members`` (domain, id).

    ``tally`` (id, unresolved, total) says how many calls leave a node, where edges keep only those that were placed.
    ``hot`` are the hubs among sources and targets.
    """
    members = work.save(members)
    count = lambda c: F.count(F.when(c, 1))
    g_ids = work.save(nodes.select("id", "type", "file_path", "namespace"))
    out_of = split_join(edges.select("source", "target", "type", "type_only"), members.withColumnRenamed("id", "source"), ["source"], "inner", hot[0])
    within = work.save(out_of.join(members.withColumnRenamed("id", "target"), ["domain", "target"], "left_semi"))
    links = lambda kind: within.where(F.col("type") == kind).select("domain", F.col("source").alias("src"), F.col("target").alias("dst"))
    into = links("CALLS").groupBy("domain", F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))
    out = links("CALLS").groupBy("domain", F.col("src").alias("id")).agg(F.count("*").alias("fan_out"))
    calls = edges.where("type = 'CALLS'").select("source", "target")
    importers = edges.where("type = 'IMPORTS'").select(F.col("target").alias("source"), F.col("source").alias("target")).distinct()
    met = calls.join(importers, ["source", "target"], "left_semi").select("source").distinct()
    routers = calls.groupBy("source").agg(F.count("*").alias("n")).where(F.col("n") > ROUTER).join(met, "source", "left_anti").select(F.col("source").alias("id"), F.lit(1).alias("router"))
    rows = members.join(into, ["domain", "id"], "left").join(out, ["domain", "id"], "left").join(routers, "id", "left").na.fill(0)
    base = rows.groupBy("domain").agg(F.count("*").alias("node_count"), count((F.col("fan_in") > HUB) & (F.col("fan_out") == 0)).alias("hub_count"), count((F.col("fan_out") > STAR) & (F.col("fan_in") <= 1)).alias("star_count"), F.sum("router").alias("router_count"))
    n_edges = within.groupBy("domain").agg(F.count("*").alias("edge_count"))
    if tally is None:
        space = g_ids.select(F.col("id").alias("target"), "namespace")
        left = split_join(out_of.where("type = 'CALLS'").select("domain", "target"), space, ["target"], "left", hot[1])
        bad = F.col("namespace").isNull() | (F.col("namespace") == "UNKNOWN") | F.col("target").startswith(RAW_CALL)
        ratio = left.groupBy("domain").agg((count(bad) / F.count("*")).alias("unresolved_ratio"))
    else:
        ratio = members.join(tally, "id").groupBy("domain").agg((F.sum("unresolved") / F.sum("total")).alias("unresolved_ratio"))
    chains = root_depths(links("CALLS"), work).groupBy("domain").agg(F.avg("length").alias("chain_len"))
    depths = root_depths(links("IMPORTS"), work).groupBy("domain").agg(F.max("length").alias("dag_depth"))
    # Cycles within a domain: ids are told apart by it, as domains may lie within each other.
    files = members.join(g_ids.where("type in ('FILE', 'MODULE')"), "id").select("domain", "id", "file_path")
    tag = lambda c: F.concat("domain", F.lit("\x1f"), c)
    runtime = within.where("type = 'IMPORTS' and not coalesce(type_only, false)").select("domain", F.col("source").alias("src"), F.col("target").alias("dst"))
    runtime = runtime.join(files.select("domain", F.col("id").alias("src")), ["domain", "src"], "left_semi").join(files.select("domain", F.col("id").alias("dst")), ["domain", "dst"], "left_semi")
    cyclic = strong_components(runtime.select(tag("src").alias("src"), tag("dst").alias("dst")), work).select("id")
    paths = files.select("domain", "file_path", tag("id").alias("id")).join(cyclic, "id", "left_semi").select("domain", "file_path").distinct().withColumn("hit", F.lit(1))
    in_cycle = members.join(g_ids.select("id", "file_path"), "id").join(paths, ["domain", "file_path"], "left").groupBy("domain").agg((F.count("hit") / F.count("*")).alias("cycle_ratio"))
    imports = _looked_through(nodes, edges, members, links("IMPORTS"), work)
    shares = lambda d, name: normalized(triad_census(d)).groupBy("domain").agg(F.map_from_entries(F.collect_list(F.struct("triad", "share"))).alias(name))
    zero = F.create_map(*[x for t in TRIADS for x in (F.lit(t), F.lit(0.0))])
    found = base
    for part in (n_edges, ratio, chains, depths, in_cycle, shares(imports, "t_imports"), shares(links("CALLS"), "t_calls")):
        found = found.join(part, "domain", "left")
    found = found.na.fill(0, ["edge_count", "unresolved_ratio", "chain_len", "dag_depth", "cycle_ratio"]).withColumn("t_imports", F.coalesce("t_imports", zero)).withColumn("t_calls", F.coalesce("t_calls", zero))
    tangle = lambda c: sum([F.col(c)[t] * m for t, m in MUTUAL.items()], F.lit(0.0)) / 3
    keep = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("unresolved_ratio")))
    return work.save(found.withColumn("tangle_ratio", F.greatest(tangle("t_imports"), keep * tangle("t_calls"))).select("domain", "node_count", "edge_count", *MEASURES, "t_imports", "t_calls"))


def scores(prints: DataFrame, bindings: list[Binding], catalog: Catalog, default_tolerance: float = 0.5) -> DataFrame:
    """name, pattern, prefix, status, score, tolerance, tv_imports, tv_calls, residual, breaches, acknowledged, violations, enforce, profile: one row a binding.

    With a pattern's shape and a profile's layers the score is the weighted distance of both layers and
    the bounds, calls fading with what is unresolved; else the bounds alone. ``residual`` is the distance of the shapes
    alone, null without any. Broken limits, relaxed by the baseline, fail the gate; a pattern's own bounds only score.
    Bindings, their bounds and their shapes become small tables that meet the fingerprints, one row for each measure or triad.
    """
    spark = prints.sparkSession
    plain, bounds, shapes = [], [], []
    for i, b in enumerate(bindings):
        profile = catalog.profiles.get(b.profile or "", {})
        weights, layers, ideal = profile.get("weights") or {}, profile.get("layers"), catalog.templates.get(b.pattern or "")
        shaped = bool(ideal and layers)
        scored, gate = catalog.scored_bounds(b), relaxed_bounds(catalog.hygiene, b.baseline)
        of = lambda layer: float(layers[layer]) if shaped else 0.0  # noqa: E731,B023
        plain.append((i, b.name, b.pattern, b.prefix, b.enforce, b.profile, float(default_tolerance if b.tolerance is None else b.tolerance), of("imports"), of("calls"), (of("gates") if shaped else 1.0) if scored else 0.0))
        bounds += [(i, "score", n, op, float(v), float(weights.get(n, 0.0)), False) for n, (op, v) in scored.items()]
        bounds += [(i, "gate", n, op, float(v), 0.0, n in b.baseline) for n, (op, v) in gate.items()]
        heavy = profile.get("triad_weights") or {}
        shapes += [(i, layer, k, float(ideal[layer].get(k, 0.0)), float(heavy.get(k, 1.0))) for layer in ("imports", "calls") for k in TRIADS] if shaped else []
    rows = spark.createDataFrame(plain, "nth int, name string, pattern string, prefix string, enforce boolean, profile string, tolerance double, w_imports double, w_calls double, w_gates double")
    limits = spark.createDataFrame(bounds, "nth int, part string, measure string, op string, bound double, weight double, known boolean")
    ideals = spark.createDataFrame(shapes, "nth int, layer string, triad string, ideal double, heavy double")
    of_domain = F.broadcast(rows.select("nth", F.col("prefix").alias("domain")))
    keep = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("unresolved_ratio")))
    values = prints.select("domain", keep.alias("keep"), F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in MEASURES])).alias("m")).select("domain", "keep", "m.*")
    x, v = F.col("value"), F.col("bound")
    met = values.join(of_domain, "domain").join(F.broadcast(limits), ["nth", "measure"])
    lack, over = F.greatest(F.lit(0.0), v - x), F.greatest(F.lit(0.0), x - v)
    raw = F.when(F.col("op") == "min", lack).when(F.col("op") == "max", over).otherwise(F.abs(x - v))
    broken = F.when(F.col("op") == "min", x < v).when(F.col("op") == "max", x > v).otherwise(x != v)
    met = met.withColumn("off", F.least(F.lit(1.0), raw / F.greatest(v, F.lit(1.0)))).withColumn("broken", broken).withColumn("eff", F.col("weight") * F.when(F.col("measure").isin(*CALLS_LAYER), F.col("keep")).otherwise(1.0))
    # A bound the gate has told of already is not told of again.
    told = met.where("part = 'gate' and (broken or known)").select("nth", "measure", F.lit(True).alias("told"))
    met = met.join(told, ["nth", "measure"], "left")
    names = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("measure")))), ",")
    score, gate = F.col("part") == "score", F.col("part") == "gate"
    sums = met.groupBy("nth").agg(F.sum(F.when(score, F.col("weight"))).alias("raw"), F.sum(F.when(score, F.col("eff"))).alias("eff"), F.sum(F.when(score, F.col("eff") * F.col("off"))).alias("weighed"), F.avg(F.when(score, F.col("off"))).alias("mean"), names(gate & F.col("broken")).alias("breaches"), names(gate & F.col("known") & ~F.col("broken")).alias("acknowledged"), names(score & F.col("broken") & F.col("told").isNull()).alias("violations"))
    shares = prints.select("domain", F.lit("imports").alias("layer"), F.explode("t_imports").alias("triad", "share")).unionByName(prints.select("domain", F.lit("calls").alias("layer"), F.explode("t_calls").alias("triad", "share")))
    far = shares.join(of_domain, "domain").join(F.broadcast(ideals), ["nth", "layer", "triad"]).groupBy("nth", "layer").agg(F.sum("share").alias("all"), (F.sum(F.abs(F.col("share") - F.col("ideal")) * F.col("heavy")) / 2).alias("tv")).where("all > 0")
    tv = far.groupBy("nth").agg(*[F.max(F.when(F.col("layer") == k, F.col("tv"))).alias(f"tv_{k}") for k in ("imports", "calls")])
    found = rows.join(F.broadcast(prints.select(F.col("domain").alias("prefix"), "node_count", "edge_count", keep.alias("keep"))), "prefix", "left").join(sums, "nth", "left").join(tv, "nth", "left").na.fill(0, ["node_count", "edge_count"])
    gates = F.when(F.col("raw").isNull(), 0.0).when(F.col("raw") <= 0, F.col("mean")).when(F.col("eff") > 0, F.col("weighed") / F.col("eff")).otherwise(0.0)
    wi, wc = F.when(F.col("tv_imports").isNotNull(), F.col("w_imports")).otherwise(0.0), F.when(F.col("tv_calls").isNotNull(), F.col("w_calls") * F.col("keep")).otherwise(0.0)
    found = found.withColumn("gates", gates).withColumn("wi", wi).withColumn("wc", wc).withColumn("shape", F.col("wi") * F.coalesce("tv_imports", F.lit(0.0)) + F.col("wc") * F.coalesce("tv_calls", F.lit(0.0)))
    trusted, total = F.col("wi") + F.col("wc"), F.col("wi") + F.col("wc") + F.col("w_gates")
    found = found.withColumn("residual", F.when(trusted > 0, F.col("shape") / trusted)).withColumn("score", F.when(total > 0, (F.col("shape") + F.col("w_gates") * F.col("gates")) / total).otherwise(0.0))
    signal = (F.col("node_count") > 0) & (F.col("edge_count") > 0)
    status = F.when(F.col("node_count") == 0, "empty").when(F.col("edge_count") == 0, "no_signal").when(F.col("breaches") != "", "gate_failed").when(F.col("score") > F.col("tolerance"), "critical").when(F.col("score") > WARNING_BAND * F.col("tolerance"), "warning").otherwise("clean")
    shown = [F.when(signal, F.col(k)).otherwise("" if k in ("breaches", "acknowledged", "violations") else 0.0 if k == "score" else None).alias(k) for k in ("score", "tv_imports", "tv_calls", "residual", "breaches", "acknowledged", "violations")]
    return found.select("name", "pattern", "prefix", status.alias("status"), "tolerance", *shown, "enforce", "profile")


def template_scores(prints: DataFrame, profiles: dict[str, str], catalog: Catalog) -> DataFrame:
    """domain, template, score, residual, rank: each template's whole score for each domain (prefix to profile) that has nodes and links, best first, then by name."""
    tries = [Binding(f"{d}\x1f{t}", d, t, 1.0, p) for d, p in sorted(profiles.items()) for t in sorted({*catalog.templates, *catalog.bounds})]
    rows = scores(prints, tries, catalog).where("status not in ('empty', 'no_signal')").select(F.col("prefix").alias("domain"), F.col("pattern").alias("template"), "score", "residual")
    order = F.array_sort(F.collect_list(F.struct(F.round("score", 12).alias("s"), "template", "score", "residual")))
    return rows.groupBy("domain").agg(order.alias("t")).select("domain", F.posexplode("t").alias("k", "x")).select("domain", "x.template", "x.score", "x.residual", (F.col("k") + 1).alias("rank"))


def fits(ranked: DataFrame, max_residual: float = MAX_RESIDUAL) -> DataFrame:
    """domain, nearest, nearest_residual, runner_up, runner_up_residual, band (good, weak, none) of domains whose shape can be told."""
    at = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    near = ranked.groupBy("domain").agg(at(1, "template").alias("nearest"), at(1, "residual").alias("nearest_residual"), at(2, "template").alias("runner_up"), at(2, "residual").alias("runner_up_residual")).where("nearest_residual is not null")
    band = F.when(F.col("nearest_residual") > max_residual, "none").when(F.col("nearest_residual") <= min(GOOD_FIT, max_residual), "good").otherwise("weak")
    return near.withColumn("band", band)


def quotient(g: Graph, bindings: list[Binding]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges, tally of the graph whose nodes are the bound packages; of nested ones the innermost has a node."""
    spark, work = g.work.spark, g.work
    domains = spark.createDataFrame([(f"{QUOTIENT}.{b.name}", b.name, b.prefix) for b in bindings], "qid string, name string, domain string")
    inner = members_of(g.nodes, [b.prefix for b in bindings]).groupBy("id").agg(F.max_by("domain", F.length("domain")).alias("domain"))
    of = work.save(inner.join(F.broadcast(domains.groupBy("domain").agg(F.min("qid").alias("qid"))), "domain").select("id", "qid"))
    side = lambda c, n: of.select(F.col("id").alias(c), F.col("qid").alias(n))
    out = work.save(g.meet(g.typed("IMPORTS", "CALLS").select("source", "target", "type"), side("source", "a"), "source"))
    both = g.meet(out, side("target", "b"), "target").where("a <> b").groupBy("a", "b", "type").agg(F.count("*").cast("double").alias("weight"))
    edges = both.select(F.concat_ws(":", "a", "type", "b").alias("id"), F.col("a").alias("source"), F.col("b").alias("target"), "type", "weight", F.lit(False).alias("type_only"))
    nodes = domains.select(F.col("qid").alias("id"), F.lit("MODULE").alias("type"), F.col("domain").alias("file_path"), F.lit("INTERNAL").alias("namespace"), F.lit(None).cast("string").alias("metadata"))
    space = g.nodes.select(F.col("id").alias("target"), "namespace")
    bad = F.col("namespace").isNull() | (F.col("namespace") == "UNKNOWN") | F.col("target").startswith(RAW_CALL)
    tally = g.meet(out.where("type = 'CALLS'"), space, "target", "left").groupBy(F.col("a").alias("id")).agg(F.count(F.when(bad, 1)).alias("unresolved"), F.count("*").alias("total"))
    return work.save(nodes), work.save(edges), work.save(tally)


@dataclass(frozen=True)
class DriftRun:
    """reports (one row a binding, with the fit), coverage (prefix: packages no binding reaches), and whether an enforced binding fails."""

    reports: DataFrame
    coverage: DataFrame
    failed: DataFrame


def uncovered_packages(g: Graph, bindings: Iterable[Binding]) -> DataFrame:
    """prefix: the packages of ``domain_discovery`` that no binding is, lies in or lies below."""
    found = domain_discovery(g.nodes)
    for b in bindings:
        p = F.col("prefix")
        found = found.where(~((p == b.prefix) | p.startswith(b.prefix + ".") | F.lit(b.prefix).startswith(F.concat(p, F.lit(".")))))
    return found


def drift_run(g: Graph, catalog: Catalog, max_drift: float = 0.5, profile: str | None = None, max_residual: float = MAX_RESIDUAL) -> DriftRun:
    """Scores every bound package and the quotient of all; with ``profile`` those of it and those of none."""
    work = g.work
    chosen = lambda bs: [b for b in bs if profile is None or b.profile in (None, profile)]
    domains, levels = chosen(catalog.domains), chosen(catalog.levels)
    prints = fingerprints(g.nodes, g.edges, members_of(g.nodes, [b.prefix for b in domains]), work, hot=(g.hot("source"), g.hot("target")))
    rows = scores(prints, domains, catalog, max_drift).withColumn("level", F.lit("package"))
    fit = fits(template_scores(prints, {b.prefix: b.profile for b in domains if b.profile}, catalog), max_residual)
    rows = rows.join(fit.withColumnRenamed("domain", "prefix"), "prefix", "left")
    for c in ("nearest", "nearest_residual", "runner_up", "runner_up_residual", "band"):
        rows = rows.withColumn(c, F.when(F.col("profile").isNotNull(), F.col(c)))
    if levels:
        nodes, edges, tally = quotient(g, domains)
        level = scores(fingerprints(nodes, edges, members_of(nodes, [b.prefix for b in levels]), work, tally), levels, catalog, max_drift).withColumn("level", F.lit("project"))
        rows = rows.unionByName(level, allowMissingColumns=True)
    rows = work.save(rows)
    failed = rows.where("enforce and status in ('critical', 'gate_failed', 'empty')").agg((F.count("*") > 0).alias("failed"))
    return DriftRun(rows, uncovered_packages(g, domains), failed)


def propose(g: Graph, prefixes: DataFrame, catalog: Catalog, profile: str = "python", margin: float = MARGIN, min_nodes: int = MIN_NODES) -> DataFrame:
    """prefix, pattern (null where only limits apply), tolerance, reason, runner_up, baseline (name to acknowledged value) that pass on the graph as it is.

    The best template names a package of enough nodes and any inner link, if its score is not above NO_FIT;
    the tolerance is the score with the margin, rounded up to hundredths. A limit that is broken is acknowledged at the
    measured value, rounded up. ``prefixes`` are a few candidates and become bindings.
    """
    names = sorted(r[0] for r in prefixes.select("prefix").distinct().toLocalIterator())
    prints = fingerprints(g.nodes, g.edges, members_of(g.nodes, names), g.work, hot=(g.hot("source"), g.hot("target")))
    ranked = template_scores(prints, {n: profile for n in names}, catalog)
    at = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    best = ranked.groupBy("domain").agg(at(1, "template").alias("best"), at(1, "score").alias("score"), at(2, "template").alias("runner_up"))
    plain = scores(prints, [Binding(n, n, None, None, profile) for n in names], replace(catalog, templates={})).select(F.col("prefix").alias("domain"), F.col("score").alias("limits"))
    rows = prints.join(best, "domain", "left").join(plain, "domain", "left")
    reason = F.when(F.col("node_count") < min_nodes, "too small").when(F.col("edge_count") == 0, "no links").when(F.col("score") > NO_FIT, "no template fits")
    up = lambda c: F.ceil(F.round(c * 100, 9)) / 100
    tolerance = up(F.when(reason.isNull(), F.col("score")).otherwise(F.coalesce("limits", F.lit(0.0))) + margin)
    base = F.map_filter(F.create_map(*[x for n, (op, v) in catalog.hygiene.items() if op == "max" for x in (F.lit(n), F.when(F.col(n) > v, up(F.col(n))))]), lambda _, v: v.isNotNull())
    return rows.select(F.col("domain").alias("prefix"), F.when(reason.isNull(), F.col("best")).alias("pattern"), tolerance.alias("tolerance"), reason.alias("reason"), "runner_up", base.alias("baseline"))
