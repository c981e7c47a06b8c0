"""Drift of packages from templates: constraints, gates, distances and fit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairngraph.operators.motifs import TRIADS, tv_distance

# The shapes a package may have, as shares of triads of imports and calls.
TEMPLATES = {
    "pure_utility": {"021U": 1.0},
    "pipeline_stage": {"021C": 1.0},
    "orchestrator": {"021D": 1.0},
    "layered_dag": {"021D": 0.5, "021C": 0.5},
    "dispatcher": {"021D": 1.0},
    "funnel": {"021U": 0.5, "021C": 0.5},
}
# Limits every package must keep, and what a good and a poor fit are.
HYGIENE = {"cycle_ratio": ("max", 0.0), "unresolved_ratio": ("max", 0.2), "tangle_ratio": ("max", 0.25)}
GOOD_FIT, MAX_RESIDUAL, WARNING_BAND = 0.25, 0.45, 0.75
CALLS_LAYER = ("hub_count", "star_count", "chain_len", "router_count")


@dataclass(frozen=True)
class Layers:
    imports: float = 0.4
    calls: float = 0.4
    gates: float = 0.2


def constraints(text: dict[str, dict[str, object]], params: dict[str, float]) -> dict[str, tuple[str, float]]:
    """min, max or exact bounds by name, ``$name`` taken from ``params``."""
    out = {}
    for name, bound in text.items():
        ((op, value),) = bound.items()
        out[name] = (op, float(params[value[1:]] if isinstance(value, str) and value.startswith("$") else value))
    return out


def component(value: Column, op: str, bound: float) -> Column:
    """How far a value is off one bound, between 0 and 1."""
    raw = {"min": F.greatest(F.lit(0.0), F.lit(bound) - value), "max": F.greatest(F.lit(0.0), value - F.lit(bound)), "exact": F.abs(value - F.lit(bound))}[op]
    return F.least(F.lit(1.0), raw / max(bound, 1.0))


def breach(value: Column, op: str, bound: float) -> Column:
    return {"min": value < bound, "max": value > bound, "exact": value != bound}[op]


def constraint_drift(rows: DataFrame, bounds: dict[str, tuple[str, float]], weights: dict[str, float]) -> DataFrame:
    """Adds ``drift``: the weighted mean of what the bounds are off; call counters fade with unresolved_ratio."""
    discount = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("unresolved_ratio")))
    raw = {n: float(weights.get(n, 0.0)) for n in bounds}
    if not bounds:
        return rows.withColumn("drift", F.lit(0.0))
    if sum(raw.values()) <= 0:
        each = [component(F.col(n), *b) / len(bounds) for n, b in bounds.items()]
        return rows.withColumn("drift", sum(each[1:], each[0]))
    eff = {n: F.lit(w) * (discount if n in CALLS_LAYER else F.lit(1.0)) for n, w in raw.items()}
    total = sum(list(eff.values())[1:], list(eff.values())[0])
    top = [eff[n] * component(F.col(n), *b) for n, b in bounds.items()]
    return rows.withColumn("drift", F.when(total > 0, sum(top[1:], top[0]) / total).otherwise(0.0))


def relaxed_bounds(bounds: dict[str, tuple[str, float]], baseline: dict[str, float]) -> dict[str, tuple[str, float]]:
    """Limits relaxed by what is acknowledged: the looser of both, and for exact ones what is acknowledged."""
    looser = {"max": max, "min": min, "exact": lambda _, known: known}
    return {n: (op, looser[op](b, baseline[n]) if n in baseline else b) for n, (op, b) in bounds.items()}


def hygiene_gate(rows: DataFrame, bounds: dict[str, tuple[str, float]] = HYGIENE, baseline: dict[str, float] | None = None) -> DataFrame:
    """Adds breaches (names of the limits a row breaks) and failed; a baseline can relax a limit, never tighten it."""
    relaxed = relaxed_bounds(bounds, baseline or {})
    names = F.filter(F.array(*[F.when(breach(F.col(n), *b), F.lit(n)) for n, b in relaxed.items()]), lambda x: x.isNotNull())
    return rows.withColumn("breaches", F.array_join(names, ",")).withColumn("failed", F.col("breaches") != "")


def ideals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, k, float(s.get(k, 0.0))) for t, s in TEMPLATES.items() for k in TRIADS], "template string, triad string, share double")


def template_fit(imports: DataFrame, calls: DataFrame, unresolved: DataFrame, layers: Layers = Layers()) -> DataFrame:
    """domain, template, residual, rank, fit: each template's distance over both layers, best first, then by name.

    A layer without triads does not count; calls fade with the domain's unresolved_ratio.
    """
    spark = imports.sparkSession
    empty = lambda s: s.groupBy("domain").agg(F.sum("share").alias("_all")).where("_all > 0").select("domain")
    ti = tv_distance(imports, ideals(spark)).join(empty(imports), "domain", "left_semi").withColumnRenamed("distance", "di")
    tc = tv_distance(calls, ideals(spark)).join(empty(calls), "domain", "left_semi").withColumnRenamed("distance", "dc")
    both = ti.join(tc, ["domain", "template"], "full").join(unresolved.select("domain", "unresolved_ratio"), "domain", "left")
    discount = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce("unresolved_ratio", F.lit(0.0))))
    wi = F.when(F.col("di").isNotNull(), layers.imports).otherwise(0.0)
    wc = F.when(F.col("dc").isNotNull(), layers.calls * discount).otherwise(0.0)
    rows = both.withColumn("residual", F.when(wi + wc > 0, (wi * F.coalesce("di", F.lit(0.0)) + wc * F.coalesce("dc", F.lit(0.0))) / (wi + wc)).otherwise(0.0))
    order = F.array_sort(F.collect_list(F.struct(F.round("residual", 9).alias("r"), "template")))
    ranked = rows.groupBy("domain").agg(order.alias("t")).select("domain", F.posexplode("t").alias("rank", "x"))
    fit = F.when(F.col("x.r") <= GOOD_FIT, "good").when(F.col("x.r") <= MAX_RESIDUAL, "weak").otherwise("none")
    return ranked.select("domain", "x.template", F.col("x.r").alias("residual"), (F.col("rank") + 1).alias("rank"), fit.alias("fit"))


def status(score: Column, tolerance: float, failed: Column, nodes: Column, edges: Column) -> Column:
    return F.when(nodes == 0, "empty").when(edges == 0, "no_signal").when(failed, "gate_failed").when(score > tolerance, "critical").when(score > WARNING_BAND * tolerance, "warning").otherwise("clean")


def domain_discovery(nodes: DataFrame) -> DataFrame:
    """prefix: the children of the first level of ids, from the roots down, that branches.

    A level is the common head of all ids, which the two extreme ones tell.
    """
    ids = nodes.where("file_path <> 'EXTERNAL'").select("id")
    least, most = ids.agg(F.min("id"), F.max("id")).first()
    if least is None:
        return ids.select(F.col("id").alias("prefix")).where("false")
    a, b = least.split("."), most.split(".")
    same = 0
    while same < min(len(a), len(b)) and a[same] == b[same]:
        same += 1
    return ids.where(F.size(F.split("id", "[.]")) > same).select(F.substring_index("id", ".", same + 1).alias("prefix")).distinct() if least != most else ids.select(F.col("id").alias("prefix"))


def domain_dependencies(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """source, target, n_calls: domains whose nodes call another domain's."""
    d = nodes.select("id", F.explode("domains").alias("domain")).distinct()
    e = calls.select("source", "target").join(d.select(F.col("id").alias("source"), F.col("domain").alias("a")), "source").join(d.select(F.col("id").alias("target"), F.col("domain").alias("b")), "target")
    return e.where("a <> b").groupBy(F.col("a").alias("source"), F.col("b").alias("target")).agg(F.count("*").alias("n_calls"))
