"""Queries for names, packages and reports over the clean graph, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairngraph.functions.text import sql_path
from cairngraph.operators import diffcheck, lookup, metrics, structure
from cairngraph.operators import drift_run as dr
from cairngraph.sources.tables import table
from cairngraph.plans.graph_queries import _COUNTERS, _HOLD, _IDEALS, _KIND, _MODULES, _RATIO, _WEIGHT, BAD, KEYED, PACKAGE, _depth_sql, _shares_sql, _triad_sql, folder_query, query

#: Where the graph is taken to have been read from, for names that begin with a directory above it.
ROOTS = lookup.path_roots("/w/srv/app", ["pkg"])
_ROOTS = "(" + ", ".join(f"'{r}'" for r in ROOTS) + ")"

_ASKED = """asked as (select distinct substr(target, 10) as name from e where starts_with(target, 'raw_call:') union select distinct 'srv.app.' || id from n where type = 'FILE'
    union select distinct 'nowhere.' || id from n where type = 'CLASS' union select distinct array_to_string(string_split(id, '.')[-2:], '.') from n union select 'srv.app.pkg.' || id from n where type = 'MODULE')"""


@query(f"""{_ASKED}, rest as (select name from asked where name not in (select id from n)),
  hit as (select rest.name, n.id, row_number() over (partition by rest.name order by n.id) as k from rest join n on ends_with(n.id, '.' || rest.name)),
  few as (select name, list(id order by id) as ids from hit where k <= 11 group by 1),
  cut as (select name, k, array_to_string(p[k + 1:], '.') as id from (select name, string_split(name, '.') as p, unnest(range(1, len(string_split(name, '.')))) as k from rest where name not in (select name from few)) where array_to_string(p[1:k], '.') in {_ROOTS}),
  short as (select name, arg_min(id, k) as id from cut where id in (select id from n) group by 1)
  select asked.name, coalesce(case when asked.name in (select id from n) then asked.name end, case when len(ids) = 1 then ids[1] end, short.id) as resolved,
    asked.name not in (select id from n) and coalesce(case when len(ids) = 1 then ids[1] end, short.id) is not null as via_suffix,
    case when len(ids) > 1 then array_to_string(ids[1:10], ' ') else '' end as candidates, coalesce(len(ids) > 10, false) as truncated
  from asked left join few using (name) left join short using (name)""")
def fqn_resolution(g):
    """Names of unresolved calls, last parts of ids, and ids below directories that no id has."""
    last = F.array_join(F.slice(F.split("id", "[.]"), F.greatest(F.size(F.split("id", "[.]")) - 1, F.lit(1)), F.lit(2)), ".")
    raw = g.edges.where("target like 'raw\\\\_call:%'").select(F.substr("target", F.lit(10)).alias("name"))
    below = lambda head, kind: g.nodes.where(F.col("type") == kind).select(F.concat(F.lit(head), "id").alias("name"))
    names = raw.unionByName(below("srv.app.", "FILE")).unionByName(below("nowhere.", "CLASS")).unionByName(g.nodes.select(last.alias("name"))).unionByName(below("srv.app.pkg.", "MODULE"))
    return lookup.resolve_names(g, names, ROOTS).withColumn("candidates", F.array_join("candidates", " "))


@query(f"""asked as (select distinct array_to_string(p[1:greatest(len(p) - 1, 1)], '.') as prefix from (select string_split(id, '.') as p from n) union select distinct 'srv.app.' || split_part(id, '.', 1) from n union select distinct 'app.' || id from n where type = 'FILE' union select 'app.nothing.here'),
  cut as (select prefix, 0 as k, prefix as head from asked union all select prefix, len(p) - k, array_to_string(p[k + 1:], '.') from (select prefix, string_split(prefix, '.') as p, unnest(range(1, len(string_split(prefix, '.')))) as k from asked) where array_to_string(p[1:k], '.') in {_ROOTS}),
  heads as (select distinct array_to_string(p[1:k], '.') as head from (select string_split(id, '.') as p, unnest(range(1, len(string_split(id, '.')) + 1)) as k from n where namespace = 'INTERNAL'))
  select asked.prefix, coalesce((select arg_min(head, k) from cut where cut.prefix = asked.prefix and head in (from heads)), asked.prefix) as effective from asked""")
def effective_prefix(g):
    parts = F.split("id", "[.]")
    packages = g.nodes.select(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), ".").alias("prefix"))
    more = g.nodes.select(F.concat(F.lit("srv.app."), F.substring_index("id", ".", 1)).alias("prefix")).unionByName(g.nodes.where("type = 'FILE'").select(F.concat(F.lit("app."), "id").alias("prefix")))
    return lookup.effective_prefixes(g, packages.unionByName(more).unionByName(g.work.spark.createDataFrame([("app.nothing.here",)], "prefix string")), ROOTS)


@query(f"select exists (select 1 from n where namespace = 'INTERNAL' and (id = '{PACKAGE}' or starts_with(id, '{PACKAGE}.'))) as covered")
def prefix_coverage(g):
    return lookup.covers_internal(g, PACKAGE)


@query("select * exclude (ingested_at, domains) from n where id in (select distinct target from e where type = 'EXTENDS')")
def node_lookup(g):
    """The nodes of a list of ids, here of all base classes; the graph holds living nodes alone, so deleted_at is null."""
    found = lookup.fetch_nodes(g, g.typed("EXTENDS").select(F.col("target").alias("id")))
    return found.drop("ingested_at", "domains").withColumn("deleted_at", F.lit(None).cast("timestamp"))


@query("""c as (select array_to_string(p[1:least(2, greatest(len(p) - 1, 1))], '.') as prefix, count(*) filter (not is_test) as a, count(*) filter (is_test) as b from (select *, string_split(id, '.') as p from inode where type <> 'FILE') group by 1),
  k as (select 'production' as kind, prefix, a as symbols from c where a > 0 union all select 'test', prefix, b from c where b > 0)
  select kind, cast(nth as int) as nth, prefix, symbols, greatest(n - 15, 0) as omitted from (select *, row_number() over (partition by kind order by symbols desc, prefix) as nth, count(*) over (partition by kind) as n from k) where nth <= 15""")
def overview_packages(g):
    return lookup.overview_packages(g)


_KEEP = f"not contains('.' || {{0}} || '.', '.tests.') and ({{0}} = '{PACKAGE}' or starts_with({{0}}, '{PACKAGE}.') or {{0}} = 'vostmark_1c' or starts_with({{0}}, 'vostmark_1c.'))"


@query(f"""ci as (select target as id, count(*) as d from e where type = 'CALLS' group by 1), co as (select source as id, count(*) as d from e where type = 'CALLS' and target in (select id from inode) group by 1),
  bo as (select n.id, coalesce(ci.d, 0) as a, coalesce(co.d, 0) as b, row_number() over (order by coalesce(ci.d, 0) + coalesce(co.d, 0) desc, n.id) as nth from inode n left join ci using (id) left join co using (id) where type in ('FUNCTION', 'METHOD') and {_KEEP.format('n.id')}),
  go as (select id, d, row_number() over (order by d desc, id) as nth from (select e.source as id, count(*) as d from e join n on n.id = e.source where e.type = 'DECLARES' and n.type = 'CLASS' and {_KEEP.format('e.source')} group by 1)),
  pp as (select distinct s.file_path as a, t.file_path as b from e join inode s on s.id = e.source join inode t on t.id = e.target where e.type in ('IMPORTS', 'CALLS') and s.file_path <> t.file_path),
  ca as (select b as file_path, count(*) as c from pp group by 1), ce as (select a as file_path, count(*) as c from pp group by 1),
  fc as (select id, coalesce(ca.c, 0) as a, coalesce(ce.c, 0) as b, row_number() over (order by coalesce(ca.c, 0) + coalesce(ce.c, 0) desc, id) as nth from inode left join ca using (file_path) left join ce using (file_path) where type = 'FILE' and {_KEEP.format('id')}),
  rs as (select count(*) filter {BAD} as a, count(*) as b from e left join n t on t.id = e.target where e.type <> 'DISPATCHES' and e.type not in {KEYED} and {_KEEP.format('e.source')})
  select 'bottlenecks' as section, cast(nth as int) as nth, id, a::double as first, b::double as second from bo where nth <= 10 union all select 'god_classes', cast(nth as int), id, d::double, null from go where nth <= 5
  union all select 'file_coupling', cast(nth as int), id, a::double, b::double from fc where nth <= 10 union all select 'resolution', 1, null, a::double, b::double from rs""")
def architecture_report(g):
    """The sections that SQL has; PageRank and cohesion have queries of their own, and architecture_report_whole all."""
    return architecture_report_whole(g).where("section not in ('critical', 'cohesion')")


@query()
def architecture_report_whole(g):
    return lookup.architecture_report(g, ["tests"], [PACKAGE, "vostmark_1c"])


_FOCUS = "big as (select source from e where type = 'DECLARES' and source in (select id from n where type = 'CLASS') group by 1 order by count(*) desc, 1 limit 1), f as (select min(target) as id from e where type = 'DECLARES' and source in (from big) and target in (select id from n where type = 'METHOD'))"


@query(f"""{_FOCUS}, o as (select min(id) as id from n where type = 'CLASS' and id in (select source from e where type in ('CONTAINS', 'DECLARES') and target in (from f)))
  select 'class' as part, id from o where id is not null union all select distinct 'member', id from n where id in (select target from e where type in ('CONTAINS', 'DECLARES') and source in (from o)) and id not in (from f)""")
def class_context(g):
    """The class of the least method of the class with most members, and its other members."""
    methods = g.nodes.where("type = 'METHOD'").select(F.col("id").alias("target"))
    biggest = metrics.god_classes(g).orderBy(F.desc("declares"), "id").limit(1).select(F.col("id").alias("source"))
    focus = g.typed("DECLARES").join(F.broadcast(biggest), "source", "left_semi").join(methods, "target", "left_semi").agg(F.min("target")).first()[0]
    owner, members = lookup.class_context(g, focus)
    return owner.select(F.lit("class").alias("part"), "id").unionByName(members.select(F.lit("member").alias("part"), "id"))


@query()
def batch_lookups(g):
    """Who calls each of a few names, one of them unknown and one ambiguous."""
    return lookup.answer_lookups(g, ["harborline.guard.require", "guard.require", "no.such.name", "config"])


# Module graphs

#: A package with many modules.
TREE = "vostmark_1c"

_REDUCE = """{p}ed as materialized (select distinct kind, source as a, target as b from {src}), {p}re as (select kind, a, b from {p}ed union select x.kind, x.a, y.b from {p}re x join {p}ed y on y.kind = x.kind and y.a = x.b),
  {p}cm as materialized (select i.kind, i.id, coalesce(least(i.id, min(r.b)), i.id) as c from (select kind, a as id from {p}ed union select kind, b from {p}ed) i left join (select r.kind, r.a, r.b from {p}re r join {p}re s on s.kind = r.kind and s.a = r.b and s.b = r.a) r on r.kind = i.kind and r.a = i.id group by 1, 2),
  {p}dg as materialized (select distinct e.kind, p.c as a, q.c as b from {p}ed e join {p}cm p on p.kind = e.kind and p.id = e.a join {p}cm q on q.kind = e.kind and q.id = e.b where p.c <> q.c),
  {p}fr as (select kind, a, b from {p}dg union select x.kind, x.a, y.b from {p}fr x join {p}dg y on y.kind = x.kind and y.a = x.b),
  {p}im as materialized (select distinct d.kind, d.a, f.b from {p}dg d join {p}fr f on f.kind = d.kind and f.a = d.b),
  {p}kept as materialized (select e.a as source, e.b as target, e.kind from {p}ed e join {p}cm p on p.kind = e.kind and p.id = e.a join {p}cm q on q.kind = e.kind and q.id = e.b where p.c = q.c or not exists (select 1 from {p}im i where i.kind = e.kind and i.a = p.c and i.b = q.c)),
  {p}ir as (select source as a, target as b from {p}kept where kind = 'imports' union select x.a, y.target from {p}ir x join {p}kept y on y.kind = 'imports' and y.source = x.b),
  {p}shown as materialized (select * from {p}kept k where not (kind = 'imports' and exists (select 1 from {p}kept x where x.kind = 'extends' and x.source = k.source and x.target = k.target) and not exists (select 1 from {p}ir where a = k.target and b = k.source)))"""


@query(f"{_MODULES}, {_REDUCE.format(p='m', src='me')} select source, target, kind from mshown", recursive=True)
def module_graph_reduced(g):
    """All files: each layer reduced by itself, then imports covered by what is left of inheritance."""
    kept = structure.reduced_layers(structure.module_edges(g), g.work)
    return structure.uncovered(kept, g.work)


@query(f"{_MODULES}, {_REDUCE.format(p='m', src='me')} select source, target, kind from mkept", recursive=True)
def module_layers_reduced(g):
    """The same by the search between levels, which large graphs take, before imports are covered."""
    return structure.reduced_layers(structure.module_edges(g), g.work, one_task=0)


def _child(c: str) -> str:
    return f"'{TREE}.' || split_part(substr({c}, {len(TREE) + 2}), '.', 1)"


_PACKAGE_EDGES = f"""{_HOLD}, pe as materialized (select s.f as a, t.f as b, {_KIND} as kind from e join held s on s.id = e.source join held t on t.id = e.target where not type_only and {_KIND} in ('imports', 'extends') and starts_with(s.f, '{TREE}.')),
  pm as materialized (select distinct {_child('a')} as source, {_child('b')} as target, kind from pe where starts_with(b, '{TREE}.') and {_child('a')} <> {_child('b')})"""


@query(f"{_PACKAGE_EDGES}, {_REDUCE.format(p='p', src='pm')} select source, target, kind from pshown", recursive=True)
def module_graph(g):
    return structure.module_graph(g, TREE).edges


@query(f"{_PACKAGE_EDGES}, {_REDUCE.format(p='p', src='pm')} select k.kind, (select count(*) from pm where kind = k.kind) - (select count(*) from pkept where kind = k.kind) as dropped, (select count(*) from pkept where kind = k.kind) - (select count(*) from pshown where kind = k.kind) as covered from (select unnest(['imports', 'extends']) as kind) k", recursive=True)
def module_graph_counts(g):
    return structure.module_graph(g, TREE).counts


@query(f"""{_PACKAGE_EDGES}, hold as (select distinct file_path, first_value(id) over (partition by file_path order by type = 'FILE' desc, id desc) as id from inode where type in ('FILE', 'MODULE')), own as (select distinct regexp_replace(id, '\\.[^.]*$', '') as id from hold where regexp_replace(id, '\\.[^.]*$', '') in (select id from hold))
  select distinct {_child('a')} as source, case when b in (from own) or not contains(b, '.') then b else regexp_replace(b, '\\.[^.]*$', '') end as package from pe where b <> '{TREE}' and not starts_with(b, '{TREE}.')""")
def module_graph_outside(g):
    return structure.module_graph(g, TREE).outside


@query()
def suggest_packages(g):
    """Figures of two packages, by children and by all files."""
    out = None
    for prefix, whole in ((TREE, False), (TREE, True), (PACKAGE, True), ("no.such", False)):
        row = structure.suggest_packages(g, prefix, with_calls=True, all_descendants=whole).verdict.select(F.lit(prefix).alias("prefix"), F.lit(whole).alias("whole"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query()
def suggest_bridges(g):
    return structure.suggest_packages(g, TREE, with_calls=True, all_descendants=True).bridges


# Drift

_CALL_COUNTERS = _COUNTERS.replace("c as (", "cc as (", 1).replace("from c group", "from cc group")
_PRINTS = f"""{_triad_sql('IMPORTS', 'i')}, {_shares_sql('i')}, {_triad_sql('CALLS', 'c')}, {_shares_sql('c')}, {_CALL_COUNTERS}, {_RATIO}, {_depth_sql('CALLS', 'p')}, {_depth_sql('IMPORTS', 'q')},
  ne as (select split_part(source, '.', 1) as domain, count(*) as edge_count from e where split_part(source, '.', 1) = split_part(target, '.', 1) and source in (select id from n) and target in (select id from n) group by 1),
  fps as materialized (select cnt.domain, n_nodes as node_count, coalesce(edge_count, 0) as edge_count, hubs as hub_count, stars as star_count, coalesce((select avg(length) from plong where plong.domain = cnt.domain), 0) as chain_len, coalesce((select max(length) from qlong where qlong.domain = cnt.domain), 0) as dag_depth, routers as router_count, cycle_ratio, unresolved_ratio,
    greatest(coalesce((select sum(share * {_WEIGHT}) / 3 from ish where domain = cnt.domain), 0), greatest(0, least(1, 1 - unresolved_ratio)) * coalesce((select sum(share * {_WEIGHT}) / 3 from csh where domain = cnt.domain), 0)) as tangle_ratio
    from cnt join rat using (domain) left join ne using (domain))"""
_FAR = "{p}tv as (select domain, template, sum(abs(share - ideal)) / 2 as d from {p}sh join ideal using (triad) where domain in (select domain from {p}census group by 1 having sum(n) > 0) group by 1, 2)"
_TEMPLATE_SCORES = f"""{_PRINTS}, {_IDEALS}, {_FAR.format(p='i')}, {_FAR.format(p='c')},
  sc as (select fps.domain, t.template, itv.d as di, ctv.d as dc, greatest(0, least(1, 1 - unresolved_ratio)) as k,
    (0.25::double * least(1, greatest(0, cycle_ratio)) + 0.15::double * least(1, greatest(0, unresolved_ratio - case when t.template = 'pure_utility' then 0.1::double else 0.2::double end)) + case when t.template = 'layered_dag' then 0.1::double * least(1, greatest(0, 3 - dag_depth) / 3) else 0 end) / case when t.template = 'layered_dag' then 0.5::double else 0.4::double end as gates
    from fps cross join (select distinct template from ideal) t left join itv on itv.domain = fps.domain and itv.template = t.template left join ctv on ctv.domain = fps.domain and ctv.template = t.template where edge_count > 0),
  ts as (select domain, template, (case when di is null then 0 else 0.35::double * di end + case when dc is null then 0 else 0.35::double * k * dc end + 0.3::double * gates) / (case when di is null then 0 else 0.35::double end + case when dc is null then 0 else 0.35::double * k end + 0.3::double) as score from sc)"""


def _prints(g):
    tops = [r[0] for r in g.nodes.select(F.substring_index("id", ".", 1)).distinct().toLocalIterator()]
    return dr.fingerprints(g.nodes, g.edges, dr.members_of(g.nodes, tops), g.work, hot=(g.hot("source"), g.hot("target"))), tops


@query(f"{_PRINTS} select domain, node_count, edge_count, hub_count, star_count, round(chain_len, 9) as chain_len, dag_depth, router_count, cycle_ratio, unresolved_ratio, round(tangle_ratio, 9) as tangle_ratio from fps", recursive=True)
def package_fingerprints(g):
    """All measures of each top package by one join of edges and members; the members may be any prefixes."""
    return _prints(g)[0].drop("t_imports", "t_calls").withColumn("chain_len", F.round("chain_len", 9)).withColumn("tangle_ratio", F.round("tangle_ratio", 9))


@query(f"{_TEMPLATE_SCORES} select domain, template, round(score, 9) as score from ts", recursive=True)
def template_scores(g):
    """The whole score of each top package against each template: both layers' distances and the bounds."""
    prints, tops = _prints(g)
    return dr.template_scores(prints, {t: "python" for t in tops}, dr.Catalog()).select("domain", "template", F.round("score", 9).alias("score"))


CATALOG = dr.Catalog(
    domains=(
        dr.Binding("tree", "vostmark_1c", "layered_dag", 0.6, "python"),
        dr.Binding("store", "vostmark_1c.store", "pure_utility", None, "python"),
        dr.Binding("shapes", "gildovar_1a", "orchestrator", 0.9, "typescript", {}, {"unresolved_ratio": 0.9, "cycle_ratio": 1.0, "tangle_ratio": 1.0}),
        dr.Binding("nothing", "no.such.package", "funnel", None, "python"),
        dr.Binding("plain", "vostora_13", None, 0.3, None, enforce=False),
    ),
    levels=(dr.Binding("whole", "quotient", "layered_dag", 0.8, "python"),),
)


@query()
def drift_run(g):
    """Reports of a few bindings: nested, empty, acknowledged, without pattern, and the quotient of all."""
    return dr.drift_run(g, CATALOG).reports.select("level", "name", "status", F.round("score", 6).alias("score"), "tolerance", "breaches", "acknowledged", "violations", "nearest", "band")


@query(f"""{_PRINTS} select name, case when node_count is null then 'empty' when edge_count = 0 then 'no_signal' when cycle_ratio > cb or unresolved_ratio > ub or tangle_ratio > tb then 'gate_failed' else 'scored' end as gate
  from (values ('tree', 'vostmark_1c', 0.0::double, 0.2::double, 0.25::double), ('shapes', 'gildovar_1a', 1.0::double, 0.9::double, 1.0::double), ('nothing', 'no.such.package', 0.0::double, 0.2::double, 0.25::double), ('plain', 'vostora_13', 0.0::double, 0.2::double, 0.25::double)) b(name, prefix, cb, ub, tb) left join fps on fps.domain = prefix""", recursive=True)
def drift_gates(g):
    """Which bindings of top packages the limits, relaxed by what is acknowledged, fail."""
    rows = dr.drift_run(g, CATALOG).reports.where("level = 'package' and name <> 'store'")
    return rows.select("name", F.when(F.col("status").isin("empty", "no_signal", "gate_failed"), F.col("status")).otherwise("scored").alias("gate"))


@query("""p as (select distinct split_part(id, '.', 1) as prefix from n where file_path <> 'EXTERNAL') select prefix from p where prefix not in ('vostmark_1c', 'gildovar_1a', 'vostora_13')""")
def drift_coverage(g):
    """Packages that no binding reaches."""
    return dr.uncovered_packages(g, CATALOG.domains)


@query()
def ontology_proposal(g):
    """A binding for each top package that passes on the graph as it is."""
    prefixes = g.internal().select(F.substring_index("id", ".", 1).alias("prefix")).distinct()
    return dr.propose(g, prefixes, dr.Catalog()).withColumn("baseline", F.to_json("baseline"))


# Changes: the lines of inheritance are new, those of imports are old, nodes were as they came first

_WHERE = "line_number is not null and file_path is not null"
_DIFF = f"""nl as (select distinct {sql_path('file_path')} as f, line_number as l from e where type = 'EXTENDS' and {_WHERE}), ol as (select distinct {sql_path('file_path')} as f, line_number as l from e where type = 'IMPORTS' and {_WHERE}),
  sy as (select id, type, name, {sql_path('file_path')} as f, start_line, end_line, is_test from n where type in ('CLASS', 'FUNCTION', 'METHOD')),
  ba as (select * from (select id, type, name, {sql_path('file_path')} as f, start_line, end_line, row_number() over (partition by id order by ingested_at, type, name, file_path, start_line, end_line) as k from nodes where type in ('CLASS', 'FUNCTION', 'METHOD')) where k = 1),
  met as (select distinct ba.id, ba.type, ba.name, ba.f from ba join ol on ol.f = ba.f and l between start_line and end_line),
  ch as (select distinct sy.id from sy join nl on nl.f = sy.f and l between start_line and end_line union select met.id from met join sy on sy.id = met.id and sy.f = met.f),
  sm as materialized (select id, type, name, 'changed' as verb from sy where id in (from ch) union all select id, type, name, 'removed' from met where id not in (from ch) and not exists (select 1 from sy where sy.id = met.id and sy.f = met.f))"""


def _diff(g, folder):
    where = g.edges.where("line_number is not null and file_path is not null").select("type", "file_path", F.col("line_number").alias("line"))
    side = lambda kind, s: where.where(F.col("type") == kind).select(F.col("file_path").alias("old_path"), F.col("file_path").alias("new_path"), F.lit(s).alias("side"), "line", F.lit(None).cast("string").alias("text"))
    rows = table(g.work.spark, folder, "nodes").where(F.col("type").isin(*diffcheck.SYMBOLS) & F.col("id").isNotNull())
    first = rows.groupBy("id").agg(F.min(F.struct("ingested_at", "type", "name", "file_path", "start_line", "end_line")).alias("r")).select("id", "r.*").drop("ingested_at")
    return g.work.save(side("EXTENDS", "new").unionByName(side("IMPORTS", "old")).distinct()), first


@folder_query(f"{_DIFF} select id, type, verb from sm")
def diff_symbols(g, folder):
    return diffcheck.changed_symbols(g, *_diff(g, folder)).select("id", "type", "verb")


@folder_query(f"""{_DIFF}, w as (select id as changed, id as spot, 0 as d from sm where type = 'CLASS' union select w.changed, e.source, d + 1 from w join e on e.type = 'EXTENDS' and e.target = w.spot and e.source <> e.target where d < 40),
  md as materialized (select changed, spot, min(d) as d from w group by 1, 2),
  sb as (select 'subclass' as kind, m.changed, m.spot as site, max(e.confidence) / m.d as score from md m join md p on p.changed = m.changed and p.d = m.d - 1 join e on e.type = 'EXTENDS' and e.target = p.spot and e.source = m.spot where m.d > 0 and m.spot <> m.changed group by 1, 2, 3, m.d),
  ca as (select 'caller' as kind, e.target as changed, e.source as site, max(e.confidence) as score from e join sm on sm.id = e.target and sm.type <> 'CLASS' where e.type = 'CALLS' and e.source <> e.target group by 1, 2, 3)
  select kind, changed, site, round(score, 9) as score from sb union all select kind, changed, site, round(score, 9) from ca""", recursive=True)
def diff_items(g, folder):
    """Subclasses and callers of all changed symbols, before they are cut to a list."""
    lines, base = _diff(g, folder)
    return diffcheck.symbol_items(g, g.work.save(diffcheck.changed_symbols(g, lines, base))).select("kind", "changed", "site", F.round("score", 9).alias("score"))


@folder_query()
def diff_check(g, folder):
    """The list a reader sees, the first 20."""
    return diffcheck.diff_check(g, *_diff(g, folder), cap=20).items


@folder_query()
def diff_summary(g, folder):
    return diffcheck.diff_check(g, *_diff(g, folder)).summary
