"""Queries over the clean graph, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairngraph.functions import paths
from cairngraph.functions.text import sql_path, sql_trim
from cairngraph.graph import Graph
from cairngraph.operators import drift, evaluation, keys, metrics, motifs, resolution, storage, structure, traversal, uplift
from cairngraph.operators.incremental import file_log
from cairngraph.schema import BEHAVIORAL, ENFORCEMENT, NODE_COLUMNS
from cairngraph.sources import sinks
from cairngraph.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_TYPE, _SOURCE, _TARGET = f"upper({sql_trim('type')})", sql_trim("source"), sql_trim("target")
_EDGE = ["weight", "confidence", "context", "file_path", "line_number", "type_only"]
_FIELDS = ", ".join(f"'has_{c}': {c} is not null, '{c}': {c}" for c in _EDGE)
#: n: living nodes, inode: nodes of the code itself, e: unique edges.
BASE = f"""n as (
  select * exclude (k) from (select *, row_number() over (partition by id order by ingested_at desc, deleted_at desc nulls last, {', '.join(c + ' desc nulls last' for c in NODE_COLUMNS)}) as k from nodes) where k = 1 and deleted_at is null),
inode as (select * from n where namespace = 'INTERNAL' and file_path <> 'EXTERNAL'),
e as (
  select id, r.source as source, r.target as target, r.type as type, {', '.join(f'r.{c} as {c}' for c in _EDGE)}
  from (select id, min({{'at': ingested_at, 'source': {_SOURCE}, 'target': {_TARGET}, 'type': {_TYPE}, {_FIELDS}}}) as r from edges group by id))"""


def query(sql: str | None = None, recursive: bool = False):
    """Registers a query of the graph; ``sql`` follows the common tables n, inode and e."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Graph.load(spark, folder))
        if sql:
            ORACLE[f.__name__] = f"with {'recursive ' if recursive else ''}{BASE}{'' if sql.lstrip().startswith('select') else ','} {sql}"
        return f

    return add


def folder_query(sql: str | None = None, recursive: bool = False):
    """Registers a query of the graph and of the tables it came from."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Graph.load(spark, folder), folder)
        if sql:
            ORACLE[f.__name__] = f"with {'recursive ' if recursive else ''}{BASE}, {sql}"
        return f

    return add


def tables_query(sql: str | None = None):
    """Registers a query of the tables as they are."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


KEYED = "('WRITES_KEY', 'READS_KEY', 'DECLARES_KEY')"
BAD = "(t.namespace is null or t.namespace = 'UNKNOWN' or starts_with(e.target, 'raw_call:'))"
ROOT, HUB, PACKAGE = "harborline.models.BaseRecord", "harborline.guard.require", "harborline"


def _top(c: str, n: int = 1) -> str:
    return f"array_to_string(string_split({c}, '.')[1:{n}], '.')"


# Storage


@query(f"""select count(*) as total, count(*) filter (t.namespace = 'INTERNAL') as resolved, count(*) filter (t.namespace = 'STDLIB') as stdlib, count(*) filter (t.namespace = 'EXTERNAL') as external,
  count(*) filter {BAD} as unresolved, count(*) filter {BAD} / count(*) as unresolved_ratio from e left join n t on t.id = e.target where e.type <> 'DISPATCHES' and e.type not in {KEYED}""")
def edge_stats(g):
    return storage.edge_stats(g)


@query(f"select {_top('e.source')} as package, count(*) as total, count(*) filter {BAD} as unresolved from e left join n t on t.id = e.target where e.type <> 'DISPATCHES' and e.type not in {KEYED} group by 1")
def resolution_by_package(g):
    return storage.resolution_by_source(g)


@query(f"select e.target, count(*) as n from e left join n t on t.id = e.target where (t.id is null or t.namespace = 'UNKNOWN') and e.type not in {KEYED} group by 1 order by n desc, 1 limit 10")
def top_unresolved(g):
    return storage.top_unresolved(g)


@query("select type, count(*) as n from inode where type <> 'FILE' group by 1")
def symbol_census(g):
    return storage.symbol_census(g)


@query("select type, count(*) as n from e group by 1")
def edge_census(g):
    return g.edges.groupBy("type").agg(F.count("*").alias("n"))


@query("""select array_to_string(p[1:least(2, greatest(len(p) - 1, 1))], '.') as prefix, count(*) filter (not is_test) as n_production, count(*) filter (is_test) as n_test
  from (select *, string_split(id, '.') as p from inode where type <> 'FILE') group by 1""")
def package_census(g):
    return storage.package_census(g, 2)


@query("""select id, type, name, case when name = 'fold' then 0 when starts_with(lower(name), 'fold') then 1 else 2 end as rank from n
  where contains(lower(name), 'fold') and type in ('FUNCTION', 'METHOD') order by rank, length(id), id limit 20""")
def symbol_search(g):
    return storage.symbol_search(g, "fold", ("FUNCTION", "METHOD"))


@query("select id, type from n where ends_with(id, '.config') order by id limit 20")
def suffix_search(g):
    return storage.suffix_search(g, "config")


@query(f"select id, file_path from n where starts_with(id, '{PACKAGE}.') and type = 'FILE' and namespace = 'INTERNAL'")
def files_under(g):
    return storage.files_under(g, PACKAGE)


@query("select file_path, count(*) as n_nodes, count(*) filter (type <> 'FILE') as n_symbols, max(end_line) as last_line from inode group by 1")
def nodes_of_files(g):
    return storage.nodes_of_files(g)


@query("select file_path, json_extract_string(metadata, '$.build_excluded') as reason from n where type = 'FILE' and json_extract_string(metadata, '$.build_excluded') is not null")
def build_excluded_files(g):
    return storage.build_excluded_files(g)


@query("select distinct target from e where source in (select id from n where not is_test)")
def referenced_targets(g):
    return storage.referenced_targets(g)


@query("select t.name, count(*) as n_calls from e join n t on t.id = e.target where e.type = 'CALLS' and t.namespace = 'UNKNOWN' group by 1")
def unknown_calls(g):
    return storage.unknown_calls(g)


@query(f"""s as (select e.target as name, e.source, e.line_number, row_number() over (partition by e.target order by e.line_number is null, e.source, e.line_number, e.id) as nth from e left join n t on t.id = e.target where e.type = 'CALLS' and {BAD})
  select name, cast(nth as int) as nth, source, line_number from s where nth <= 3""")
def unresolved_sites(g):
    return storage.unresolved_sites(g)


@query("select source, type, target, max(confidence) as confidence from e group by 1, 2, 3")
def distinct_links(g):
    return storage.distinct_links(g)


@tables_query(f"select id, file_path, start_line, ingested_at from (select *, row_number() over (partition by id order by ingested_at desc, deleted_at desc nulls last, file_path desc nulls last, start_line desc nulls last) as k from nodes) where k = 1")
def upsert_merge(spark, folder):
    return storage.upsert(table(spark, folder, "nodes").select("id", "ingested_at", "deleted_at", "file_path", "start_line"), "id", ["ingested_at"]).select("id", "file_path", "start_line", "ingested_at")


@tables_query("select id, namespace, language, name from (select *, row_number() over (partition by id order by namespace = 'UNKNOWN', language, ingested_at desc, namespace, name) as k from nodes where file_path = 'EXTERNAL') where k = 1")
def virtual_rank_merge(spark, folder):
    return storage.ranked_virtual_upsert(table(spark, folder, "nodes"))


@query("""gone as (select distinct file_path from n where is_generated),
  keptn as (select * from n where file_path not in (from gone)),
  kepte as (select * from e where source not in (select id from n where file_path in (from gone)) and (file_path is null or file_path not in (from gone)))
  select 'node' as kind, type, count(*) as n from keptn group by 2 union all select 'edge', type, count(*) from kepte group by 2""")
def delete_by_file(g):
    nodes, edges = storage.without_files(g, g.nodes.where("is_generated"))
    count = lambda d, k: d.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "type", "n")
    return count(nodes, "node").unionByName(count(edges, "edge"))


SPLIT = "2025-04-01 00:00:00"


@tables_query(f"""with late as (select * from nodes where ingested_at >= timestamptz '{SPLIT}+00'), kept as (select * from nodes where ingested_at < timestamptz '{SPLIT}+00' and id not in (select id from late))
  select type, count(*) as n from (select * from kept union all select * from late) group by 1""")
def incremental_batch(spark, folder):
    nodes, at = table(spark, folder, "nodes"), F.lit(SPLIT).cast("timestamp")
    merged = storage.incremental_nodes(nodes.where(F.col("ingested_at") < at), nodes.where(F.col("ingested_at") >= at))
    return merged.groupBy("type").agg(F.count("*").alias("n"))


_SIG = "select file_path, sha256(array_to_string(list_sort(list(distinct concat_ws('|', id, type, coalesce(metadata, '')))), chr(10))) as s from nodes where file_path <> 'EXTERNAL' and {} group by 1"


@tables_query(f"""with o as ({_SIG.format(f"ingested_at < timestamptz '{SPLIT}+00'")}), w as ({_SIG.format("true")})
  select file_path, case when o.s is null then 'added' when w.s is null then 'removed' else 'changed' end as change from o full join w using (file_path) where o.s is distinct from w.s""")
def incremental_signature(spark, folder):
    nodes = table(spark, folder, "nodes")
    return storage.signature_changes(storage.file_signatures(nodes.where(F.col("ingested_at") < F.lit(SPLIT).cast("timestamp"))), storage.file_signatures(nodes))


@tables_query(f"""with m as (select max(started_at) as mark from ingest_runs where status = 'ok'),
  s as (select {sql_path('file_path')} as f, max(scanned_at) as seen from files_state where hash is not null group by 1)
  select case when max(mark) is null then 'UNKNOWN' when count(*) filter (seen > mark) > 0 then 'STALE' else 'FRESH' end as status, count(*) filter (seen > mark) as n_stale from s, m""")
def freshness(spark, folder):
    return storage.freshness(file_log(table(spark, folder, "files_state")), table(spark, folder, "ingest_runs"))


# Metrics


@query("""i as (select target as id, count(*) as d from e where type = 'CALLS' group by 1), o as (select source as id, count(*) as d from e where type = 'CALLS' and target in (select id from inode) group by 1)
  select n.id, n.type, coalesce(i.d, 0) as in_degree, coalesce(o.d, 0) as out_degree from inode n left join i using (id) left join o using (id) where type in ('FUNCTION', 'METHOD')""")
def node_coupling(g):
    return metrics.node_coupling(g)


@query("select e.source as id, count(*) as declares from e join n on n.id = e.source where e.type = 'DECLARES' and n.type = 'CLASS' group by 1")
def god_classes(g):
    return metrics.god_classes(g)


@query("""p as (select distinct s.file_path as a, t.file_path as b from e join inode s on s.id = e.source join inode t on t.id = e.target where e.type in ('IMPORTS', 'CALLS') and s.file_path <> t.file_path),
  ca as (select b as file_path, count(*) as c from p group by 1), ce as (select a as file_path, count(*) as c from p group by 1)
  select id, file_path, coalesce(ca.c, 0) as afferent, coalesce(ce.c, 0) as efferent, coalesce(ce.c, 0) / nullif(coalesce(ca.c, 0) + coalesce(ce.c, 0), 0) as instability
  from inode left join ca using (file_path) left join ce using (file_path) where type = 'FILE'""")
def file_coupling(g):
    return metrics.file_coupling(g)


_HEALTH = "('CALLS', 'IMPORTS', 'REFERENCES', 'USES')"
_FANS = f"fi as (select target as id, count(*) as c from e where type in {_HEALTH} group by 1), fo as (select source as id, count(*) as c from e where type in {_HEALTH} group by 1)"


@query(f"{_FANS} select id, coalesce(fi.c, 0) as fan_in, coalesce(fo.c, 0) as fan_out from n left join fi using (id) left join fo using (id)")
def fan_counts(g):
    return metrics.fan_counts(g)


_DOWN = "down as (select id, id as own, 0 as d from n where type = 'FILE' union select e.target, own, d + 1 from down join e on e.source = down.id and e.type in ('CONTAINS', 'DECLARES') where d < 100)"


@query(f"{_DOWN} select n.id, cast(coalesce(min(d), 0) as int) as depth from n left join down using (id) group by 1", recursive=True)
def structural_depth(g):
    return metrics.structural_depth(g)


_RUNTIME = """imp as (select distinct source as a, target as b from e where type = 'IMPORTS' and not type_only and source <> target and source in (select id from n where namespace = 'INTERNAL' and type in ('FILE', 'MODULE')) and target in (select id from n where namespace = 'INTERNAL' and type in ('FILE', 'MODULE'))),
  reach as (select a, b from imp union select reach.a, imp.b from reach join imp on imp.a = reach.b),
  scc as (select r.a as id, least(r.a, min(r.b)) as component, count(distinct r.b) as size from reach r join reach s on s.a = r.b and s.b = r.a group by 1 having count(distinct r.b) > 1)"""


@query(f"{_RUNTIME} select id, component, size from scc", recursive=True)
def import_cycles_scc(g):
    return metrics.import_cycles(g)


@query(f"{_RUNTIME} select component as focal, count(*) as size, least(1.0, (count(*) - 1) / 4) as severity from scc group by 1", recursive=True)
def cycle_report(g):
    return metrics.cycle_report(metrics.import_cycles(g))


@query(f"""{_FANS}, {_DOWN}, top(id, own, d) as (select id, id, 0 from n where type in ('FILE', 'MODULE') union select e.target, own, d + 1 from top join e on e.source = top.id and e.type in ('CONTAINS', 'DECLARES') where d < 100),
  {_RUNTIME}, dep as (select id, min(d) as d from down group by 1), ow as (select id, arg_min(own, d) as own from top group by 1)
  select n.id, coalesce(fi.c, 0) as fan_in, coalesce(fo.c, 0) as fan_out, cast(coalesce(dep.d, 0) as int) as depth, coalesce(ow.own, n.id) in (select id from scc) as in_cycle
  from n left join fi using (id) left join fo using (id) left join dep using (id) left join ow using (id)""", recursive=True)
def health(g):
    return metrics.health(g)


def _ranks(steps: int) -> str:
    parts = ["v as (select id from inode where type in ('FUNCTION', 'METHOD', 'CLASS')), c as materialized (select source as a, target as b, count(*) as m from e where type = 'CALLS' and source in (from v) and target in (from v) group by 1, 2), deg as materialized (select a, sum(m) as d from c group by 1), nn as (select count(*) as k from v), r0 as (select id, 1.0::double / k as r from v, nn)"]
    for i in range(steps):
        parts.append(f"r{i + 1} as materialized (select v.id, 0.15::double / k + 0.85::double * (coalesce(f.s, 0) + (select coalesce(sum(r), 0) from r{i} where id not in (select a from deg)) / k) as r from v cross join nn left join (select c.b as id, sum(x.r * c.m / deg.d) as s from c join r{i} x on x.id = c.a join deg on deg.a = c.a group by 1) f on f.id = v.id)")
    return ", ".join(parts) + f" select id, round(r, 9) as rank from r{steps}"


@query(_ranks(20))
def pagerank(g):
    return metrics.pagerank(g).select("id", F.round("rank", 9).alias("rank"))


@query("""me as (select distinct c.id as c, m.id as m, m.name, json_extract(m.metadata, '$.self_attrs') as attrs, m.metadata as meta from e join n c on c.id = e.source join n m on m.id = e.target where e.type = 'DECLARES' and c.type = 'CLASS' and c.namespace = 'INTERNAL' and m.type = 'METHOD'),
  ok as (select * from me where c not in (select c from me where attrs is null) and not (starts_with(name, '__') and ends_with(name, '__')) and coalesce(json_extract_string(meta, '$.is_abstract'), 'false') <> 'true'
    and not exists (select 1 from (select unnest(from_json(coalesce(json_extract(meta, '$.decorators'), '[]'), '["VARCHAR"]')) as d) where list_extract(string_split(d, '.'), -1) in ('staticmethod', 'classmethod'))),
  att as (select c, m, unnest(list_append(from_json(attrs, '["VARCHAR"]'), name)) as x from ok),
  li as (select a.c, a.m as p, b.m as q from att a join att b on a.c = b.c and a.x = b.x union select s.c, s.m, t.m from e join ok s on s.m = e.source join ok t on t.m = e.target and t.c = s.c where e.type = 'CALLS' union select t.c, t.m, s.m from e join ok s on s.m = e.source join ok t on t.m = e.target and t.c = s.c where e.type = 'CALLS'),
  re as (select c, p, q from li union select re.c, re.p, li.q from re join li on li.c = re.c and li.p = re.q),
  le as (select c, p, min(q) as q from re group by 1, 2) select c as id, count(*) as methods, count(distinct q) as lcom4 from le group by 1""", recursive=True)
def class_cohesion_lcom4(g):
    return metrics.class_cohesion(g)


_OWN = "own as (select target as m, max(source) as c from e where type in ('CONTAINS', 'DECLARES') and target in (select id from n where type = 'METHOD') group by 1), cls as (select id, metadata from n where type = 'CLASS' and namespace = 'INTERNAL')"
_LIFT = "lift as (select distinct coalesce(s.c, e.source) as a, coalesce(t.c, e.target) as b from e left join own s on s.m = e.source left join own t on t.m = e.target where e.type = 'CALLS' and coalesce(s.c, e.source) <> coalesce(t.c, e.target))"


@query(f"""{_OWN}, {_LIFT}, w as (select id, (select count(*) from lift where b = cls.id) as ca, (select count(*) from lift where a = cls.id) as ce, coalesce(json_extract_string(metadata, '$.is_abstract'), 'false') = 'true' as ab from cls),
  z as (select id, ca, ce, ce / (ca + ce) as instability, abs(ab::int + ce / (ca + ce) - 1.0) as distance from w where ca >= 3) select * from z where instability <= 0.3 and distance >= 0.7""")
def zone_of_pain(g):
    return metrics.zone_of_pain(g)


@query(f"""{_OWN}, mine as (select m, c from own where c in (select id from cls)),
  lift as (select distinct s.c as a, coalesce(t.c, e.target) as b from e join mine s on s.m = e.source left join mine t on t.m = e.target where e.type = 'CALLS' and s.c <> coalesce(t.c, e.target)),
  w as (select c as id, count(*) as methods, (select count(*) from lift where a = mine.c) as efferent from mine group by 1)
  select id, methods, efferent, least(1.0, (methods / 4) * (efferent / 3) / 4) as severity from w where methods >= 4 and efferent >= 3""")
def god_objects(g):
    return metrics.god_objects(g, 4, 3)


@query("""used as (select target from e where type in ('CALLS', 'EXTENDS', 'REFERENCES') and source in (select id from n where not is_test))
  select id from inode where type = 'CLASS' and not is_test and not is_generated and id not in (from used) and regexp_replace(id, '\\.[^.]*$', '') not in (select id from n where type in ('CLASS', 'FUNCTION', 'METHOD') and contains(inode.id, '.'))""")
def orphan_classes(g):
    return metrics.orphan_classes(g)


@query("""select 'files' as item, count(*) filter (type = 'FILE' and namespace = 'INTERNAL') as n from n union all select 'symbols', count(*) filter (type <> 'FILE') from inode
  union all select 'edges', count(*) from e union all select 'nodes', count(*) from n""")
def overview(g):
    row = lambda d, name: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("item"), "n")
    return row(g.nodes.where("type = 'FILE' and namespace = 'INTERNAL'"), "files").unionByName(row(g.internal().where("type <> 'FILE'"), "symbols")).unionByName(row(g.edges, "edges")).unionByName(row(g.nodes, "nodes"))


# Walks


_WALK_TYPES = "(" + ", ".join(f"'{t}'" for t in BEHAVIORAL if t != "DISPATCHES") + ")"


def _walk_sql(root: str, here: str, there: str, depth: int, types: str, dispatch: bool) -> str:
    """Distances by relaxing all edges: an ordinary step costs 1, a dispatch 0; files are walked through only as roots."""
    hop = f"""select e.{there}, w.d + case when e.type = 'DISPATCHES' then 0 else 1 end from w join e on e.{here} = w.id
      where (w.d < {depth} and e.type in {types} or e.type = 'DISPATCHES' and {dispatch} and e.source <> e.target) and (w.id = '{root}' or w.id not in (select id from n where type = 'FILE'))"""
    return f"w(id, d) as (select '{root}', 0 union {hop}) select id, cast(min(d) as int) as depth from w group by 1"


@query(_walk_sql(HUB, "target", "source", 3, _WALK_TYPES, True), recursive=True)
def impact_bfs(g):
    return traversal.walk(g, [HUB], True, 3).reached


@query(_walk_sql("vostmark_1c.store.codec", "source", "target", 3, _WALK_TYPES, True), recursive=True)
def flow_bfs(g):
    return traversal.walk(g, ["vostmark_1c.store.codec"], False, 3).reached


@query()
def impact_budget(g):
    """The same walk for agents: no tests, internal nodes only, at most 200."""
    return traversal.walk(g, [HUB], True, 3, hide_tests=True, internal_only=True, budget=200).reached


@query(f"""w(id, d) as (select '{HUB}', 0 union select e.source, d + 1 from w join e on e.target = w.id where d < 1 and e.type in {_WALK_TYPES} ),
  ins as (select distinct n.id, name from n where id = '{HUB}' or id in (select id from w) ), hit as (select id, name from n where (id = '{HUB}' or id in (select id from w)) and namespace = 'INTERNAL' and type in ('FUNCTION', 'METHOD', 'CLASS'))
  select (select count(*) from e where type = 'CALLS' and target in (select id from hit)) as path_calls,
    (select count(*) from e where type = 'CALLS' and target in (select id from n where namespace = 'UNKNOWN' and name in (select name from hit) union select 'raw_call:' || name from hit)) as hidden_calls""", recursive=True)
def impact_coverage(g):
    return traversal.upstream_coverage(g, traversal.walk(g, [HUB], True, 1, dispatch=False).reached)


@query(f"""{_walk_sql(HUB, "target", "source", 5, _WALK_TYPES, True).rsplit(" select ", 1)[0]}, hit as (select id, name from n where id in (select id from w) and namespace = 'INTERNAL' and type in ('FUNCTION', 'METHOD', 'CLASS'))
  select (select count(*) from e where type = 'CALLS' and target in (select id from hit)) as path_calls,
    (select count(*) from e where type = 'CALLS' and target in (select id from n where namespace = 'UNKNOWN' and name in (select name from hit) union select 'raw_call:' || name from hit)) as hidden_calls""", recursive=True)
def impact_coverage_whole(g):
    """The whole impact walk, five steps and dispatch; impact_coverage counts at one step."""
    return traversal.upstream_coverage(g, traversal.walk(g, [HUB], True, 5).reached)


@query("""w(id, d) as (select 'harborline', 0 union select e.target, d + 1 from w join e on e.source = w.id and e.type in ('CONTAINS', 'DECLARES') where d < 4) select id, cast(min(d) as int) as depth from w group by 1""", recursive=True)
def structure_tree(g):
    return traversal.structure(g, "harborline", 4)


@query(f"""w(id, d) as (select '{ROOT}', 0 union select e.source, d + 1 from w join e on e.target = w.id and e.type = 'EXTENDS' where d < 10) select id, cast(min(d) as int) as depth from w group by 1 having min(d) > 0""", recursive=True)
def transitive_subclasses(g):
    return traversal.subclasses(g, ROOT)


_ENF = "(" + ", ".join(f"'{t}'" for t in ENFORCEMENT) + ")"


@query(f"""{_walk_sql(HUB, 'target', 'source', 5, _ENF, True).rsplit(' select ', 1)[0].replace("w(id, d) as", "w(id, d) as", 1)}
  select id, id in (select id from w) as covered from n where type = 'METHOD' and namespace = 'INTERNAL' and not is_test""", recursive=True)
def audit_reachability(g):
    return traversal.reachability_audit(g, g.internal("METHOD").where("not is_test"), [HUB])


@query("""lab as (select id, unnest(domains) as label from n where type in ('FILE', 'MODULE')), p as (select id, label from lab union select e.target, p.label from p join e on e.source = p.id and e.type in ('CONTAINS', 'DECLARES'))
  select label, count(distinct id) as n_ids from p group by 1""", recursive=True)
def label_propagation(g):
    labels = g.nodes.where("type in ('FILE', 'MODULE')").select("id", F.explode("domains").alias("label"))
    return traversal.propagate_labels(g, labels).groupBy("label").agg(F.countDistinct("id").alias("n_ids"))


# Structure


_HOLD = "held as (select n.id, h.id as f, h.is_test from n join (select file_path, arg_max(id, {'f': type = 'FILE', 'id': id, 't': is_test}) as id, arg_max(is_test, {'f': type = 'FILE', 'id': id, 't': is_test}) as is_test from n where type in ('FILE', 'MODULE') and namespace = 'INTERNAL' group by 1) h using (file_path) where not h.is_test)"
_KIND = "case when e.type in ('IMPORTS', 'IMPORTS_SYMBOL') then 'imports' when e.type = 'EXTENDS' then 'extends' when e.type = 'CALLS' then 'calls' end"
_MODULES = f"{_HOLD}, me as (select distinct s.f as source, t.f as target, {_KIND} as kind from e join held s on s.id = e.source join held t on t.id = e.target where not type_only and s.f <> t.f and {_KIND} is not null)"


@query(f"{_MODULES} select source, target, kind from me")
def module_graph_edges(g):
    return structure.module_edges(g)


_REDUCED = f"""{_MODULES}, ed as (select distinct source as a, target as b from me where kind = 'extends'), reach as (select a, b from ed union select reach.a, ed.b from reach join ed on ed.a = reach.b),
  comp as (select x.id, coalesce(least(x.id, min(r.b)), x.id) as c from (select a as id from ed union select b from ed) x left join (select r.a, r.b from reach r join reach s on s.a = r.b and s.b = r.a) r on r.a = x.id group by 1),
  dag as (select distinct p.c as a, q.c as b from ed join comp p on p.id = ed.a join comp q on q.id = ed.b where p.c <> q.c), far as (select a, b from dag union select far.a, dag.b from far join dag on dag.a = far.b),
  kept as (select ed.a as source, ed.b as target from ed join comp p on p.id = ed.a join comp q on q.id = ed.b where p.c = q.c or not exists (select 1 from dag join far on far.a = dag.b where dag.a = p.c and far.b = q.c))"""


@query(f"{_REDUCED} select source, target from kept", recursive=True)
def transitive_reduction(g):
    return structure.transitive_reduction(structure.module_edges(g).where("kind = 'extends'"), g.work)


@query(f"""{_MODULES}, im as (select source as a, target as b from me where kind = 'imports'), ir as (select a, b from im union select ir.a, im.b from ir join im on im.a = ir.b)
  select source, target, kind from me where not (kind = 'imports' and exists (select 1 from me x where x.kind = 'extends' and x.source = me.source and x.target = me.target) and not exists (select 1 from ir where ir.a = me.target and ir.b = me.source))""", recursive=True)
def uncovered_imports(g):
    return structure.uncovered(structure.module_edges(g), g.work)


_FILEGRAPH = f"""f as (select id from n where type in ('FILE', 'MODULE') and (id = '{PACKAGE}' or starts_with(id, '{PACKAGE}.'))),
  tails as (select id, array_to_string(p[i:], '.') as s from (select id, string_split(id, '.') as p, unnest(range(1, len(string_split(id, '.')) + 1)) as i from f)),
  uniq as (select s, min(id) as id from tails group by 1 having count(distinct id) = 1),
  names as (select distinct unnest([source, target]) as x from e where type in ('IMPORTS', 'CALLS')),
  ntails as (select x, i, array_to_string(p[i:], '.') as s from (select x, string_split(x, '.') as p, unnest(range(1, len(string_split(x, '.')) + 1)) as i from names where not starts_with(x, 'raw_call:'))),
  res as (select x, case when x in (select id from f) then x else arg_min(coalesce(f.id, uniq.id), i) end as fid from ntails left join f on f.id = ntails.s left join uniq on uniq.s = ntails.s where f.id is not null or uniq.id is not null group by 1),
  fe as (select a.fid as a, b.fid as b, weight from e join res a on a.x = e.source join res b on b.x = e.target where e.type in ('IMPORTS', 'CALLS') and a.fid <> b.fid),
  fg as (select a, b, sum(weight) as weight from (select a, b, weight from fe union all select b, a, weight from fe) group by 1, 2)"""


@query(f"{_FILEGRAPH} select a, b, round(weight, 6) as weight from fg")
def file_graph(g):
    return structure.file_graph(g, PACKAGE).withColumn("weight", F.round("weight", 6))


@query(f"{_FILEGRAPH} select {_top('a', 2)} as a, {_top('b', 2)} as b, round(sum(weight), 6) as weight from fg where {_top('a', 2)} <> {_top('b', 2)} group by 1, 2")
def children_graph(g):
    return structure.children_graph(structure.file_graph(g, PACKAGE), PACKAGE).withColumn("weight", F.round("weight", 6))


@query()
def communities(g):
    return structure.communities(*structure.package_graphs(g))


@query()
def layout_verdicts(g):
    graphs, files = structure.package_graphs(g)
    graphs = g.work.save(graphs)
    found = g.work.save(structure.communities(graphs, files))
    return structure.layout_verdicts(found.withColumn("directory", F.regexp_replace("id", r"\.[^.]*$", "")), graphs)


@tables_query("""with d as (select lower(trim(source)) as source, lower(trim(lang)) as lang from documents where source is not null and lang is not null), n as (select count(*) as n from d),
  j as (select source, lang, count(*) as c from d group by 1, 2), x as (select source, count(*) as c from d group by 1), y as (select lang, count(*) as c from d group by 1)
  select 'all' as part, n, round(1 - (select sum(j.c / n * ln(j.c * n / (x.c * y.c))) from j join x using (source) join y using (lang)) / (((select sum(-c / n * ln(c / n)) from x) + (select sum(-c / n * ln(c / n)) from y)) / 2), 9) as divergence from n""")
def partition_divergence(spark, folder):
    docs = table(spark, folder, "documents").select(F.lower(F.trim("source")).alias("source"), F.lower(F.trim("lang")).alias("lang"), F.lit("all").alias("part")).where("source is not null and lang is not null")
    return structure.partition_divergence(docs, "source", "lang", ["part"]).withColumn("divergence", F.round("divergence", 9))


# Motifs and drift


def _triad_sql(kind: str, p: str = "", links: str | None = None) -> str:
    """Common tables, their names beginning with ``p``: l (links d, a, b), census (domain, triad, n)."""
    cases = " ".join(f"when {c} then '{motifs.triad_name(c)}'" for c in range(64) if motifs.triad_name(c))
    inside = f"type = '{kind}' and {_top('source')} = {_top('target')} and source in (select id from n) and target in (select id from n)"
    bit = lambda k, x, y: f"{1 << k} * (exists (select 1 from {p}l z where z.d = {p}tr.d and z.a = t[{x}] and z.b = t[{y}]))::int"
    return f"""{p}l as materialized ({links or f"select distinct {_top('source')} as d, source as a, target as b from e where {inside} and source <> target"}),
  {p}u as materialized (select d, a, b from {p}l union select d, b, a from {p}l),
  {p}tr as materialized (select distinct x.d, list_sort([x.a, x.b, y.b]) as t from {p}u x join {p}u y on y.d = x.d and y.a = x.a and y.b > x.b),
  {p}co as (select d, {' + '.join(bit(k, x, y) for k, (x, y) in enumerate([(1, 2), (2, 1), (1, 3), (3, 1), (2, 3), (3, 2)]))} as c from {p}tr),
  {p}tri as (select d, case c {cases} end as triad, count(*) as n from {p}co group by 1, 2),
  {p}dom as ({f"select distinct d from {p}l" if links else f"select distinct {_top('source')} as d from e where {inside}"}),
  {p}census as materialized (select {p}dom.d as domain, z.triad, coalesce({p}tri.n, 0) as n from {p}dom cross join (select unnest({motifs.TRIADS}) as triad) z left join {p}tri on {p}tri.d = {p}dom.d and {p}tri.triad = z.triad)"""


@query(f"{_triad_sql('IMPORTS')} select domain, triad, n from census")
def triad_census_imports(g):
    return motifs.triad_census(motifs.domain_links(g, "IMPORTS"))


@query(f"{_triad_sql('CALLS')} select domain, triad, n from census")
def triad_census_calls(g):
    return motifs.triad_census(motifs.domain_links(g, "CALLS"))


def _shares_sql(p: str = "") -> str:
    return f"{p}sh as (select domain, triad, case when sum(n) over (partition by domain) > 0 then n / sum(n) over (partition by domain) else 0 end as share from {p}census)"


_SHARES = _shares_sql()
_WEIGHT = "case triad " + " ".join(f"when '{t}' then {m}" for t, m in motifs.MUTUAL.items()) + " else 0 end"


@query(f"{_triad_sql('CALLS')}, {_SHARES} select domain, round(sum(share * {_WEIGHT}) / 3, 9) as tangle from sh group by 1")
def tangle_mass(g):
    return motifs.tangle_mass(motifs.normalized(motifs.triad_census(motifs.domain_links(g, "CALLS")))).withColumn("tangle", F.round("tangle", 9))


_IDEALS = "ideal as (select * from (values " + ", ".join(f"('{t}', '{k}', {s.get(k, 0.0)}::double)" for t, s in drift.TEMPLATES.items() for k in motifs.TRIADS) + ") v(template, triad, ideal))"


@query(f"{_triad_sql('IMPORTS')}, {_SHARES}, {_IDEALS} select domain, template, round(sum(abs(share - ideal)) / 2, 9) as distance from sh join ideal using (triad) group by 1, 2")
def tv_distance(g):
    shares = motifs.normalized(motifs.triad_census(motifs.domain_links(g, "IMPORTS")))
    return motifs.tv_distance(shares, drift.ideals(g.work.spark)).withColumn("distance", F.round("distance", 9))


_COUNTERS = f"""c as (select source as a, target as b from e where type = 'CALLS' and {_top('source')} = {_top('target')} and source in (select id from n) and target in (select id from n)),
  fi as (select b as id, count(*) as k from c group by 1), fo as (select a as id, count(*) as k from c group by 1), ao as (select source as id, count(*) as k from e where type = 'CALLS' group by 1),
  met as (select distinct c.source as id from e c join e i on i.type = 'IMPORTS' and i.target = c.source and i.source = c.target where c.type = 'CALLS'),
  bad as (select e.source as id, count(*) as k from e left join n t on t.id = e.target where e.type = 'CALLS' and {BAD} group by 1),
  w as (select {_top('n.id')} as domain, coalesce(fi.k, 0) as fi, coalesce(fo.k, 0) as fo, coalesce(ao.k, 0) as ao, met.id as met, coalesce(bad.k, 0) as bad from n left join fi using (id) left join fo using (id) left join ao using (id) left join met using (id) left join bad using (id)),
  cnt as (select domain, count(*) as n_nodes, count(*) filter (fi > 2 and fo = 0) as hubs, count(*) filter (fo > 3 and fi <= 1) as stars, count(*) filter (ao > 2 and met is null) as routers, case when sum(ao) > 0 then sum(bad) / sum(ao) else 0 end as unresolved_ratio from w group by 1)"""


@query(f"{_COUNTERS} select domain, n_nodes, hubs, stars, routers, unresolved_ratio from cnt")
def fingerprint_counters(g):
    return motifs.fingerprint_counters(g)


_RATIO = f"""fl as (select id from n where type in ('FILE', 'MODULE')), di as (select distinct source as a, target as b from e where type = 'IMPORTS' and not type_only and source <> target and {_top('source')} = {_top('target')} and source in (from fl) and target in (from fl)),
  dr as (select a, b from di union select dr.a, di.b from dr join di on di.a = dr.b), cy as (select distinct r.a as id from dr r join dr s on s.a = r.b and s.b = r.a where r.a <> r.b),
  cp as (select distinct {_top('n.id')} as d, file_path from n join cy using (id)),
  rat as (select {_top('n.id')} as domain, count(cp.d) / count(*) as cycle_ratio from n left join cp on cp.d = {_top('n.id')} and cp.file_path = n.file_path group by 1)"""


@query(f"{_RATIO} select domain, cycle_ratio from rat", recursive=True)
def cycle_ratio(g):
    return motifs.cycle_ratio(g)


@query(f"""{_COUNTERS}, {_RATIO} select domain, cycle_ratio, unresolved_ratio, concat_ws(',', case when cycle_ratio > 0 then 'cycle_ratio' end, case when unresolved_ratio > 0.2 then 'unresolved_ratio' end) as breaches, cycle_ratio > 0 or unresolved_ratio > 0.2 as failed from cnt join rat using (domain)""", recursive=True)
def hygiene_gate(g):
    """All three limits; the SQL knows those of cycles and of unresolved calls only, that of hygiene_gate_whole all."""
    return hygiene_gate_whole(g).drop("tangle_ratio")


_TANGLE = f"""{_triad_sql('IMPORTS', 'i')}, {_shares_sql('i')}, {_triad_sql('CALLS', 'c')}, {_shares_sql('c')}, {_COUNTERS.replace('c as (', 'cc as (', 1).replace('from c group', 'from cc group')}, {_RATIO},
  ti as (select domain, sum(share * {_WEIGHT}) / 3 as v from ish group by 1), tc as (select domain, sum(share * {_WEIGHT}) / 3 as v from csh group by 1),
  hy as (select domain, cycle_ratio, unresolved_ratio, greatest(coalesce(ti.v, 0), greatest(0, least(1, 1 - unresolved_ratio)) * coalesce(tc.v, 0)) as tangle_ratio from cnt join rat using (domain) left join ti using (domain) left join tc using (domain))"""


@query(f"""{_TANGLE} select domain, cycle_ratio, unresolved_ratio, round(tangle_ratio, 9) as tangle_ratio, concat_ws(',', case when cycle_ratio > 0 then 'cycle_ratio' end, case when unresolved_ratio > 0.2 then 'unresolved_ratio' end, case when tangle_ratio > 0.25 then 'tangle_ratio' end) as breaches,
  cycle_ratio > 0 or unresolved_ratio > 0.2 or tangle_ratio > 0.25 as failed from hy""", recursive=True)
def hygiene_gate_whole(g):
    shares = lambda k: motifs.normalized(motifs.triad_census(motifs.domain_links(g, k)))
    counters = g.work.save(motifs.fingerprint_counters(g).select("domain", "unresolved_ratio"))
    rows = motifs.cycle_ratio(g).join(counters, "domain").join(motifs.tangle_ratio(shares("IMPORTS"), shares("CALLS"), counters), "domain")
    return drift.hygiene_gate(rows).withColumn("tangle_ratio", F.round("tangle_ratio", 9))


_TV = "{p}tv as (select domain, template, sum(abs(share - ideal)) / 2 as d from {p}sh join ideal using (triad) where domain in (select domain from {p}census group by 1 having sum(n) > 0) group by 1, 2)"


@query(f"""{_triad_sql('IMPORTS', 'i')}, {_shares_sql('i')}, {_triad_sql('CALLS', 'c')}, {_shares_sql('c')}, {_IDEALS}, {_TV.format(p='i')}, {_TV.format(p='c')}, {_COUNTERS.replace('c as (', 'cc as (', 1).replace('from c group', 'from cc group')},
  w as (select 1), x as (select domain, template, itv.d as di, ctv.d as dc, greatest(0, least(1, 1 - coalesce(unresolved_ratio, 0))) as k from itv full join ctv using (domain, template) left join cnt using (domain)),
  y as (select domain, template, coalesce(round((0.4::double * coalesce(di, 0) + case when dc is null then 0 else 0.4::double * k * dc end) / nullif(case when di is null then 0 else 0.4::double end + case when dc is null then 0 else 0.4::double * k end, 0), 9), 0) as residual from x)
  select domain, template, residual, cast(row_number() over (partition by domain order by residual, template) as int) as rank, case when residual <= 0.25 then 'good' when residual <= 0.45 then 'weak' else 'none' end as fit from y""".replace("  w as (select 1), x as", "  x as"))
def template_fit(g):
    shares = lambda k: g.work.save(motifs.normalized(motifs.triad_census(motifs.domain_links(g, k))))
    return drift.template_fit(shares("IMPORTS"), shares("CALLS"), motifs.fingerprint_counters(g))


@query(f"""l as (select distinct {_top('source')} as d, source as a, target as b from e where type = 'DISPATCHES' and {_top('source')} = {_top('target')} and source in (select id from n) and target in (select id from n)),
  lr as (select a, b from l union select lr.a, l.b from lr join l on l.a = lr.b), dg as (select * from l where a <> b and not exists (select 1 from lr where lr.a = l.b and lr.b = l.a)),
  ro as (select distinct d, a from l where a <> b and a not in (select b from l where a <> b)), w as (select d, a as r, a as x, 0 as k from ro union select w.d, w.r, dg.b, k + 1 from w join dg on dg.d = w.d and dg.a = w.x)
  select d as domain, r as src, cast(max(k) as int) as length from w group by 1, 2""", recursive=True)
def chain_lengths(g):
    return motifs.longest_ways(motifs.domain_links(g, "DISPATCHES"), g)


def _depth_sql(kind: str, p: str) -> str:
    """Common tables, their names beginning with ``p``, the last of them long (domain, src, length): longest ways from roots, each cycle one node."""
    return f"""{p}l as materialized (select distinct {_top('source')} as d, source as a, target as b from e where type = '{kind}' and {_top('source')} = {_top('target')} and source in (select id from n) and target in (select id from n)),
  {p}r as (select a, b from {p}l union select {p}r.a, {p}l.b from {p}r join {p}l on {p}l.a = {p}r.b),
  {p}c as (select x.a as id, min(y.a) as c from {p}r x join {p}r y on y.a = x.b and y.b = x.a group by 1),
  {p}g as (select distinct d, coalesce(p.c, a) as a, coalesce(q.c, b) as b from {p}l left join {p}c p on p.id = a left join {p}c q on q.id = b where coalesce(p.c, a) <> coalesce(q.c, b)),
  {p}w as (select d, a as r, a as x, 0 as k from {p}l where a not in (select b from {p}l) union select {p}w.d, r, {p}g.b, k + 1 from {p}w join {p}g on {p}g.a = {p}w.x),
  {p}long as (select d as domain, r as src, cast(max(k) as int) as length from {p}w group by 1, 2)"""


@query(f"{_depth_sql('CALLS', 'c')} select domain, src, length from clong", recursive=True)
def call_chain_lengths(g):
    return motifs.root_depths(motifs.domain_links(g, "CALLS"), g.work)


@query(f"{_depth_sql('IMPORTS', 'i')} select domain, src, length from ilong", recursive=True)
def import_depths(g):
    return motifs.root_depths(motifs.domain_links(g, "IMPORTS"), g.work)


@query(f"""{_COUNTERS}, {_depth_sql('CALLS', 'p')}, {_depth_sql('IMPORTS', 'q')}
  select domain, n_nodes, hubs, stars, routers, unresolved_ratio, coalesce((select avg(length) from plong where plong.domain = cnt.domain), 0) as chain_len, coalesce((select max(length) from qlong where qlong.domain = cnt.domain), 0) as dag_depth from cnt""", recursive=True)
def fingerprint(g):
    return motifs.fingerprint(g)


@query(f"select {_top('e.source')} as source, {_top('e.target')} as target, e.type, count(*) as weight from e where e.type in ('IMPORTS', 'CALLS') and source in (select id from inode) and target in (select id from inode) and {_top('e.source')} <> {_top('e.target')} group by 1, 2, 3")
def quotient_edges(g):
    return motifs.quotient_edges(g)


@query(f"select {_top('e.source')} as domain, count(*) filter {BAD} as unresolved, count(*) as total from e left join n t on t.id = e.target where e.type = 'CALLS' and e.source in (select id from inode) group by 1")
def quotient_call_tally(g):
    return motifs.call_tally(g)


@query("select p.prefix as domain, count(*) as n from (select n.id, max(length(x.prefix)) as k from n join (select distinct regexp_replace(id, '\\.[^.]*$', '') as prefix from n where type = 'FILE') x on n.id = x.prefix or starts_with(n.id, x.prefix || '.') group by 1) b join (select distinct regexp_replace(id, '\\.[^.]*$', '') as prefix from n where type = 'FILE') p on length(p.prefix) = b.k and (b.id = p.prefix or starts_with(b.id, p.prefix || '.')) group by 1")
def domain_assignment(g):
    prefixes = g.nodes.where("type = 'FILE'").select(F.regexp_replace("id", r"\.[^.]*$", "").alias("prefix")).distinct()
    found = motifs.assign_domains(g.nodes.select("id"), prefixes.withColumn("domain", F.col("prefix")), g.work)
    return found.groupBy("domain").agg(F.count("*").alias("n"))


_CUT = "e.type = 'IMPORTS' and source in (select id from inode) and target in (select id from inode)"
_RUNGS = " union ".join(f"select {r} as d, {_top('source', r)} as a, {_top('target', r)} as b from e where {_CUT} and {_top('source', r)} <> {_top('target', r)}" for r in (1, 2, 3))
_LADDER = f"""{_triad_sql('', '', _RUNGS)}, {_SHARES}, gr as (select d, count(distinct x) as n_groups from (select d, unnest([a, b]) as x from l) group by 1),
  ladder as (select gr.d as rung, n_groups, (select sum(n) from census where domain = gr.d) as n_triads, coalesce((select sum(-share * log2(share)) from sh where domain = gr.d and share > 0), 0) as entropy from gr)"""


@query(f"{_LADDER} select rung, n_groups, cast(n_triads as bigint) as n_triads, round(entropy, 9) as entropy from ladder")
def tier_ladder(g):
    return motifs.tier_ladder(g, "IMPORTS").withColumn("entropy", F.round("entropy", 9))


@query(f"{_LADDER} select round(regr_slope(entropy, -log2(n_groups)), 6) as slope, round(regr_r2(entropy, -log2(n_groups)), 6) as r2, count(*) as points from ladder where n_triads >= 10 and n_groups > 1")
def entropy_fit(g):
    return motifs.entropy_fit(motifs.tier_ladder(g, "IMPORTS")).select(F.round("slope", 6).alias("slope"), F.round("r2", 6).alias("r2"), "points")


_NEAR = """{p}s as (select id, id as at from n union select {p}s.id, par.source from {p}s join n on n.id = {p}s.at and n.type not in ({stop}) join par on par.target = {p}s.at),
  {p} as (select {p}s.id, {p}s.at from {p}s join n on n.id = {p}s.at where n.type in ({stop}))"""
_STRUCTURAL_LADDER = f"""par as (select target, min(source) as source from e where type in ('CONTAINS', 'DECLARES') and source in (select id from n) group by 1),
  {_NEAR.format(p='nf', stop="'FILE', 'MODULE'")}, {_NEAR.format(p='nc', stop="'FILE', 'MODULE', 'CLASS'")},
  own as (select n.id, case when n.type in ('FUNCTION', 'METHOD', 'VARIABLE') then coalesce(nc.at, n.id) else n.id end as c, coalesce(nf.at, n.id) as f from n left join nc on nc.id = n.id left join nf on nf.id = n.id),
  dirs as (select own.*, string_split(file_path, '/')[:-2] as p from own join n on n.id = own.f),
  rung as materialized (select id, 0 as r, id as x from dirs union all select id, 1, c from dirs union all select id, 2, f from dirs
    union all select id, k + 2, case when len(p) - k + 1 <= 0 then '<root>' else array_to_string(p[1:len(p) - k + 1], '/') end from dirs, (select unnest(range(1, (select max(len(p)) + 1 from dirs))) as k)),
  {_triad_sql('', '', "select distinct e.type || ' ' || a.r as d, a.x as a, b.x as b from (select distinct type, source, target from e where type in ('IMPORTS', 'CALLS')) e join rung a on a.id = e.source join rung b on b.id = e.target and b.r = a.r where a.x <> b.x")},
  {_SHARES}, size as (select r, count(distinct x) as n_groups from rung group by 1),
  every as (select layer, r, n_groups, (select sum(n) from census where domain = layer || ' ' || r) as t, (select list((triad, n) order by triad) from census where domain = layer || ' ' || r and n > 0) as c, (select sum(-share * log2(share)) from sh where domain = layer || ' ' || r and share > 0) as entropy from size, (select unnest(['IMPORTS', 'CALLS']) as layer)),
  sl as (select layer, r as rung, n_groups, coalesce(t, 0) as n_triads, entropy from (select *, lag(c) over w as was, row_number() over w as k from every window w as (partition by layer order by r)) where k = 1 or was is distinct from c)"""


@query(f"{_STRUCTURAL_LADDER} select layer, cast(rung as int) as rung, case rung when 0 then 'T0_symbol' when 1 then 'T1_class' when 2 then 'T2_module' else 'T' || rung || '_up' || (rung - 2) end as name, n_groups, cast(n_triads as bigint) as n_triads, round(entropy, 9) as entropy from sl", recursive=True)
def structural_ladder(g):
    return motifs.structural_ladder(g).withColumn("entropy", F.round("entropy", 9))


@query(f"""{_STRUCTURAL_LADDER}, xy as (select layer, case when n_triads >= 10 and n_groups > 1 then -log2(n_groups) end as x, case when n_triads >= 10 and n_groups > 1 then entropy end as y from sl),
  ft as (select layer, regr_slope(y, x) as b, regr_sxx(y, x) as sxx, regr_syy(y, x) as syy, regr_r2(y, x) as r2, regr_count(y, x) as points from xy group by 1),
  se as (select layer, points, case when points >= 3 and sxx >= 1e-12 then b end as slope, case when points >= 3 and sxx >= 1e-12 then case when syy > 1e-12 then r2 else 0 end end as r2, case when points >= 3 and sxx >= 1e-12 then sqrt(greatest(0, syy - b * b * sxx) / (points - 2) / sxx) end as std_error from ft)
  select layer, round(slope, 6) as slope, round(r2, 6) as r2, round(std_error, 6) as std_error, cast(points as bigint) as points, case when slope is null then 'no_signal' when slope > 2 * std_error then 'hierarchical' when slope < -2 * std_error then 'flat' else 'scale_invariant' end as verdict from se""", recursive=True)
def ladder_fit(g):
    fit = motifs.ladder_fit(motifs.structural_ladder(g))
    return fit.select("layer", *[F.round(c, 6).alias(c) for c in ("slope", "r2", "std_error")], "points", "verdict")


@query("select distinct split_part(id, '.', 1) as prefix from n where file_path <> 'EXTERNAL'")
def domain_discovery(g):
    return drift.domain_discovery(g.nodes)


@query("""d as (select distinct id, unnest(domains) as d from n) select a.d as source, b.d as target, count(*) as n_calls from e join d a on a.id = e.source join d b on b.id = e.target where e.type = 'CALLS' and a.d <> b.d group by 1, 2""")
def domain_dependencies(g):
    return drift.domain_dependencies(g.nodes, g.typed("CALLS"))


# Keys and changes


_KEYS = f"k as (select target as key, split_part(substr(target, 5), '|', 1) as namespace, substr(target, 6 + length(split_part(substr(target, 5), '|', 1))) as path, source, file_path, type from e where type in {KEYED} and starts_with(target, 'key:'))"


@query(f"{_KEYS}, d as (select distinct key, namespace, path from k) select x.key as a, y.key as b from d x join d y on x.path = y.path and x.key < y.key and (x.namespace = y.namespace or x.namespace = '' or y.namespace = '')")
def key_match(g):
    return keys.key_matches(keys.key_sites(g))


@query(f"""{_KEYS} select key, count(distinct file_path) as n_files, round(len(string_split(path, '.')) + (namespace <> '')::int - log2(greatest(count(distinct file_path), 1)), 9) as specificity, namespace = '' and count(distinct file_path) > 8 as dropped from k group by key, namespace, path""")
def key_specificity(g):
    return keys.key_specificity(keys.key_sites(g)).withColumn("specificity", F.round("specificity", 9))


@query(f"{_KEYS}, d as (select distinct key, namespace, path from k) select x.key as outer_key, y.key as inner_key from d x join d y on x.namespace = y.namespace and starts_with(y.path, x.path || '.')")
def keys_inside(g):
    return keys.keys_inside(keys.key_sites(g))


_LINES = f"li as (select distinct {sql_path('file_path')} as file_path, line_number as line from e where line_number is not null and file_path is not null)"


@query(f"{_LINES} select n.id, li.file_path, li.line from n join li on li.file_path = {sql_path('n.file_path')} and li.line between n.start_line and n.end_line")
def diff_span_join(g):
    lines = g.edges.where("line_number is not null and file_path is not null").select("file_path", F.col("line_number").alias("line"))
    return keys.span_join(g.nodes, lines)


@query("select e.target as changed, e.source as site, count(*) as n_calls from e where e.type = 'CALLS' and source <> target and target in (select id from n where is_generated) group by 1, 2")
def changed_callers(g):
    return keys.changed_callers(g, g.nodes.where("is_generated"))


# Resolution


@query("""t as (select id, array_to_string(p[i:], '.') as s from (select id, string_split(id, '.') as p, unnest(range(1, len(string_split(id, '.')) + 1)) as i from inode)) select s as suffix, min(id) as id from t group by 1 having count(distinct id) = 1""")
def symbol_suffixes(g):
    return resolution.symbol_suffixes(g)


@query("""c as (select id, name, language, file_path from inode where type in ('FUNCTION', 'METHOD', 'CLASS')), l as (select name, language, min(id) as id from c group by 1, 2 having count(*) = 1), f as (select name, file_path, min(id) as id from c group by 1, 2 having count(*) = 1)
  select e.id as edge_id, coalesce(l.id, f.id) as resolved, case when coalesce(l.id, f.id) is null then 0.8 else 1.0 end::double as confidence
  from e left join n s on s.id = e.source left join l on l.name = substr(e.target, 10) and l.language = s.language left join f on f.name = substr(e.target, 10) and f.file_path = s.file_path where e.type = 'CALLS' and starts_with(e.target, 'raw_call:')""")
def raw_call_resolution(g):
    return resolution.resolve_raw_calls(g)


@query("""r as (select distinct split_part(id, '.', 1) as root from inode) select coalesce(n.namespace, case when split_part(t.id, '.', 1) in (from r) then 'INTERNAL' end, 'UNKNOWN') as namespace, count(*) as n_targets from (select distinct target as id from e) t left join n using (id) group by 1""")
def namespace_classification(g):
    return resolution.classify_targets(g)


@query("select e.type, case when t.namespace = 'UNKNOWN' then least(confidence, 0.8) else confidence end as confidence, count(*) as n from e left join n t on t.id = e.target group by 1, 2")
def capped_confidence(g):
    return resolution.capped_confidence(g)


@query("""m as (select id, regexp_replace(id, '\\.[^.]*$', '') as c, name from n where type = 'METHOD' and not is_test and not (starts_with(name, '__') and ends_with(name, '__'))),
  x as (select distinct source as c, target as p from e where type = 'EXTENDS' and source <> target), up as (select c, p, 1 as k from x union select up.c, x.p, k + 1 from up join x on x.c = up.p where k < 40),
  b as (select m.id as target, o.id as source, min(k) as k from m join up on up.c = m.c join m o on o.c = up.p and o.name = m.name group by 1, 2)
  select source, target from (select target, min(source) as source from b join (select target, min(k) as k from b group by 1) q using (target, k) group by 1) where source <> target""", recursive=True)
def dispatch_edges(g):
    return resolution.hierarchy_dispatch(g)


# Evaluation, over tables that hold judgements or events


@tables_query("""with o as (select o_orderpriority as slice, count(*) filter (o_orderstatus = 'F') as tp, count(*) filter (o_orderstatus = 'O') as fp, count(*) filter (o_orderstatus = 'P') as fn from orders group by 1), p as (select *, tp / (tp + fp) as precision, tp / (tp + fn) as recall from o)
  select slice, tp, fp, fn, precision, recall, 5 * precision * recall / (4 * precision + recall) as f_beta from p""")
def f_beta_slices(spark, folder):
    hit = lambda s: (F.col("o_orderstatus") == s).cast("long")
    rows = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("slice"), hit("F").alias("tp"), hit("O").alias("fp"), hit("P").alias("fn"))
    return evaluation.score_slices(rows, "slice")


@tables_query("""with j as (select l_returnflag = 'R' as x, l_linestatus = 'F' as y from lineitem), s as (select count(*) as n, count(*) filter (x = y) / count(*) as o, count(*) filter (x) / count(*) as p, count(*) filter (y) / count(*) as q, count(*) filter (x and y) as b, count(*) filter (x or y) as e from j)
  select n, o as agreement, (o - (p * q + (1 - p) * (1 - q))) / (1 - (p * q + (1 - p) * (1 - q))) as kappa, b / e as positive_agreement from s""")
def cohen_kappa(spark, folder):
    rows = table(spark, folder, "lineitem").select((F.col("l_returnflag") == "R").alias("x"), (F.col("l_linestatus") == "F").alias("y"))
    return evaluation.agreement(rows, "x", "y")


@tables_query("""with q as (select l_quantity as v, count(*) as c from lineitem group by 1), rq as (select v, coalesce(sum(c) over (order by v rows between unbounded preceding and 1 preceding), 0) + (c + 1) / 2 as r from q),
  d as (select l_discount as v, count(*) as c from lineitem group by 1), rd as (select v, coalesce(sum(c) over (order by v rows between unbounded preceding and 1 preceding), 0) + (c + 1) / 2 as r from d)
  select count(*) as n, round(corr(rq.r, rd.r), 9) as rho from lineitem join rq on rq.v = l_quantity join rd on rd.v = l_discount""")
def spearman_ranked(spark, folder):
    return evaluation.spearman(table(spark, folder, "lineitem").select("l_quantity", "l_discount"), "l_quantity", "l_discount").withColumn("rho", F.round("rho", 9))


@tables_query("""with d as (select c_custkey, avg(o_totalprice) - max(c_acctbal) as delta from customer join orders on o_custkey = c_custkey group by 1)
  select count(*) as n, round(avg(delta), 4) as mean, round(stddev_samp(delta), 4) as deviation, round(stddev_samp(delta) / sqrt(count(*)), 4) as error, avg(delta) > 2 * stddev_samp(delta) / sqrt(count(*)) as passes from d""")
def paired_effect(spark, folder):
    rows = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey").agg((F.avg("o_totalprice") - F.max("c_acctbal")).alias("delta"))
    out = evaluation.paired_effect(rows, "delta")
    return out.select("n", *[F.round(c, 4).alias(c) for c in ("mean", "deviation", "error")], "passes")


@tables_query("with x as (select event_type, lead(event_type) over (partition by user_id order by ts, event_id) as next_type from events) select next_type, count(*) as n from x where event_type = 'click' group by 1")
def next_event_sufficiency(spark, folder):
    return evaluation.next_events(table(spark, folder, "events"), "click")


# Further lookups and links


@query(f"""s as (select id from inode where type = 'CLASS' and is_test) select 'out' as way, e.source as node_id, e.type, count(*) as n from e where e.source in (from s) group by 2, 3
  union all select 'in', e.target, e.type, count(*) from e where e.target in (from s) group by 2, 3""")
def edges_of_nodes(g):
    """Edges out of and into a set of nodes, here the test classes, by type."""
    asked = g.internal("CLASS").where("is_test").select("id")
    side = lambda c, way: g.edges.join(asked.withColumnRenamed("id", c), c, "left_semi").groupBy(F.lit(way).alias("way"), F.col(c).alias("node_id"), "type").agg(F.count("*").alias("n"))
    return side("source", "out").unionByName(side("target", "in"))


@query(f"""c as (select distinct source as a, target as b from e where type = 'CALLS' and target in (select id from inode) and source in (select id from inode)),
  d(id, d) as (select 'vostmark_1c.store.codec', 0 union select id, 0 from n where file_path = (select file_path from n where id = 'vostmark_1c.store.codec') union select x.v, d + 1 from d join (select a as u, b as v from c union select b, a from c) x on x.u = d.id where d < 1)
  select id, cast(min(d) as int) as depth from d group by 1""", recursive=True)
def context_neighbourhood(g):
    """What a file's symbols call and are called by, one step, in the code itself."""
    roots = g.nodes.join(g.nodes.where("id = 'vostmark_1c.store.codec'").select("file_path"), "file_path", "left_semi").select("id")
    inside = g.internal().select("id")
    c = g.typed("CALLS").select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct()
    c = c.join(inside.withColumnRenamed("id", "src"), "src", "left_semi").join(inside.withColumnRenamed("id", "dst"), "dst", "left_semi")
    both = c.unionByName(c.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    root = g.work.spark.createDataFrame([("vostmark_1c.store.codec",)], "id string")
    return traversal.min_depths(both, roots.unionByName(root), g.work, 1)


@query("""m as (select distinct s.id as c, t.name as m, coalesce(json_extract_string(s.metadata, '$.is_abstract'), 'false') = 'true' as ab from e join n s on s.id = e.source join n t on t.id = e.target where e.type = 'DECLARES' and s.type = 'CLASS' and t.type = 'METHOD'),
  need as (select c, count(*) as k from m where ab group by 1)
  select a.c as interface, b.c as type from m a join m b on b.m = a.m and not b.ab join need on need.c = a.c where a.ab group by 1, 2, need.k having count(*) = need.k""")
def interface_dispatch(g):
    """Classes that declare every method an abstract class declares."""
    own = g.typed("DECLARES").select("source", "target").distinct()
    cls = g.nodes.where("type = 'CLASS'").select(F.col("id").alias("source"), (F.coalesce(F.get_json_object("metadata", "$.is_abstract"), F.lit("false")) == "true").alias("ab"))
    got = own.join(cls, "source").join(g.nodes.where("type = 'METHOD'").select(F.col("id").alias("target"), F.col("name").alias("method")), "target").select("source", "method", "ab", F.lit(None).cast("int").alias("arity")).distinct()
    return resolution.interface_dispatch(got.where("ab").select(F.col("source").alias("interface"), "method", "arity"), got.where("not ab").select(F.col("source").alias("type"), "method", "arity"))


@query("""x as (select distinct source as c, target as b from e where type = 'EXTENDS' and source <> target), many as (select c from x group by 1 having count(*) > 1),
  up as (select c, b, 1 as k from x union select up.c, x.b, k + 1 from up join x on x.c = up.b where k < 60), bad as (select distinct c from up where c in (select c from many) or b in (select c from many) or b = c or k >= 60)
  select c as class, cast(0 as int) as nth, c as member from x where c not in (from bad) union all select c, cast(k as int), b from up where c not in (from bad)""", recursive=True)
def single_method_order(g):
    """The order of classes without two bases anywhere above, where it is the line of bases."""
    order = method_order(g)
    x = g.typed("EXTENDS").select(F.col("source").alias("class"), F.col("target").alias("base")).where("class <> base").distinct()
    many = g.work.save(x.groupBy("class").count().where("count > 1").select("class"))
    touched = order.join(many.select(F.col("class").alias("member")), "member", "left_semi").select("class").distinct()
    return order.join(touched, "class", "left_anti")


@query()
def method_order(g):
    """C3 order of every class; bases in the order of their lines, then of arrival."""
    links = g.typed("EXTENDS").where("source <> target")
    first = links.groupBy(F.col("source").alias("class"), F.col("target").alias("base")).agg(F.min(F.struct(F.coalesce("line_number", F.lit(1 << 30)).alias("line"), "ingested_at", "id")).alias("at"))
    nth = F.row_number().over(Window.partitionBy("class").orderBy("at"))  # a class has few bases
    return resolution.method_order(first.select("class", "base", nth.alias("position")), g.work)


DOMAINS = {"tests": {"file_path_patterns": ["*/tests/*"]}, "api": {"fqn_patterns": ["*.api.*"]}}


@query("""lab as (select id, unnest(domains) as label from n union select id, 'tests' from n where namespace = 'INTERNAL' and file_path like '%/tests/%' union select id, 'api' from n where namespace = 'INTERNAL' and id like '%.api.%'),
  p as (select id, label from lab union select e.target, p.label from p join e on e.source = p.id and e.type in ('CONTAINS', 'DECLARES')), own as (select distinct id, label from p where id in (select id from n))
  select a.label as source, b.label as target, count(*) as n_calls from e join own a on a.id = e.source join own b on b.id = e.target where e.type = 'CALLS' and a.label <> b.label group by 1, 2""", recursive=True)
def uplift_dependencies(g):
    return uplift.uplift(g, DOMAINS)[1]


@query("select file_path, regexp_matches(file_path, '(^|[/\\\\])tests?([/\\\\]|$)') or regexp_matches(file_path, '(^|[/\\\\])(test_[^/\\\\]*|[^/\\\\]*_test|conftest|tests?)\\.pyi?$') as is_test, count(*) as n_nodes from inode group by 1")
def test_paths(g):
    return g.internal().groupBy("file_path").agg(F.count("*").alias("n_nodes")).select("file_path", paths.is_test("file_path").alias("is_test"), "n_nodes")


@query(f"{_MODULES} select source, {_top('target')} as package, count(distinct target) as n_files from me where {_top('source')} <> {_top('target')} group by 1, 2")
def outside_dependencies(g):
    """source, package, n_files: what each file needs of other top packages."""
    me = structure.module_edges(g).select("source", "target").distinct()
    top = lambda c: F.substring_index(c, ".", 1)
    return me.where(top("source") != top("target")).groupBy("source", top("target").alias("package")).agg(F.count("*").alias("n_files"))


@query()
def graph_json(g):
    """Every node and distinct link as a JSON text."""
    return sinks.graph_json(g.nodes, g.edges)


@query("select e.context, e.type, count(*) as n, count(distinct e.source) as n_sources from e where e.context is not null group by 1, 2")
def value_contexts(g):
    """context, type, n, n_sources: how functions are handed on as values."""
    e = g.edges.where("context is not null").select("context", "type", "source")
    return e.groupBy("context", "type", "source").agg(F.count("*").alias("k")).groupBy("context", "type").agg(F.sum("k").alias("n"), F.count("*").alias("n_sources"))
