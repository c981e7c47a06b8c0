"""The queries p1 to p5 over a graph directory, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairngraph.functions.text import sql_path, sql_trim
from cairngraph.operators.hierarchy import descendant_pairs, node_hierarchies, node_paths
from cairngraph.operators.hot_keys import hot_pairs, pair_profile
from cairngraph.operators.incremental import changed_counts, changed_files
from cairngraph.operators.references import orphan_counts, orphan_references
from cairngraph.operators.snapshots import graph_changes
from cairngraph.sources.tables import table
from cairngraph.workspace import Workspace


def p1_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return pair_profile(table(spark, folder, "edges"), Workspace(spark, "p1"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return hot_pairs(pair_profile(table(spark, folder, "edges"), Workspace(spark, "p1"))).select("type", "target")


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_references(table(spark, folder, "edges"), table(spark, folder, "nodes"), Workspace(spark, "p2"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("edge_id", "side", "reason")


def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_counts(_orphans(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return changed_files(table(spark, folder, "files_state"), table(spark, folder, "ingest_runs"), spark)


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    return changed_counts(p3_found(spark, folder))


def p4_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    return node_hierarchies(table(spark, folder, "edges"), Workspace(spark, "p4")).drop("has_parent", "entry", "exit")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return node_hierarchies(table(spark, folder, "edges"), Workspace(spark, "p4")).where("has_parent").select("hierarchy", "node_id", "root_id", "depth")


def p4_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Descendants of x: same hierarchy and root, x.entry < entry < x.exit. No SQL: the order of siblings is free; p4_descendants is checked."""
    return node_hierarchies(table(spark, folder, "edges"), Workspace(spark, "p4")).drop("has_parent")


def p4_descendants(spark: SparkSession, folder: str) -> DataFrame:
    work = Workspace(spark, "p4")
    return descendant_pairs(work.save(node_hierarchies(table(spark, folder, "edges"), work)))


def p4_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The paths that end; p4_all_paths has the chains that never do, too."""
    return p4_all_paths(spark, folder).where("path is not null")


def p4_all_paths(spark: SparkSession, folder: str) -> DataFrame:
    return node_paths(table(spark, folder, "edges"), Workspace(spark, "p4"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return graph_changes(table(spark, folder, "snapshots"), Workspace(spark, "p5"))


def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    return p5_found(spark, folder).groupBy("snapshot_no", "change").agg(F.count("*").alias("n_ids"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pairs, p2_found, p2_counts, p3_found, p3_counts, p4_found, p4_hierarchy, p4_intervals, p4_descendants, p4_paths, p4_all_paths, p5_found, p5_counts)}

TYPE, SOURCE, TARGET = f"upper({sql_trim('type')})", sql_trim("source"), sql_trim("target")

_FIRST = f"""first_edges as (
  select id, s.* from (select id, min({{'at': ingested_at, 'source': {SOURCE}, 'target': {TARGET}, 'type': {TYPE}, 'has_weight': weight is not null, 'weight': weight, 'has_file': file_path is not null, 'file_path': file_path}}) as s from edges group by id))"""

_ORPHANS = f"""refs as (
  select id as edge_id, 'source' as side, {SOURCE} as key, min(ingested_at) as t from edges group by 1, 2, 3
  union all select id, 'target', {TARGET}, min(ingested_at) from edges group by 1, 2, 3),
known as (select id, min(ingested_at) as first from nodes group by id),
alive as (select distinct edge_id, side from refs join nodes on nodes.id = refs.key and ingested_at <= t and (deleted_at is null or deleted_at > t)),
orphans as (
  select edge_id, side, t, case when first is null then 'missing' when first > t then 'late' else 'deleted' end as reason
  from refs left join known on known.id = refs.key anti join alive using (edge_id, side)
  where not regexp_matches(key, '^(raw_[A-Za-z]*:|self\\.)'))"""

_CHANGED = f"""said as (
  select {sql_path('file_path')} as f, lower({sql_trim('hash')}) as h, scanned_at, state_id, arrived_at from files_state where hash is not null),
good as (select run_id, started_at, lag(run_id) over (order by started_at) as before from ingest_runs where status = 'ok'),
at_run as (
  select run_id, f, arg_max(h, {{'a': scanned_at, 'b': state_id}}) as h from said join good on arrived_at <= started_at group by run_id, f),
changed as (
  select n.run_id, n.f as file_path from at_run n join good on good.run_id = n.run_id
  left join at_run o on o.run_id = good.before and o.f = n.f where n.h <> '' and (o.h is null or o.h <> n.h))"""

_UP = f"""links as (
  select distinct 'containment' as hierarchy, {TARGET} as node, {SOURCE} as parent from edges where {TYPE} in ('CONTAINS', 'DECLARES')
  union select distinct 'inheritance', {SOURCE}, {TARGET} from edges where {TYPE} = 'EXTENDS'),
ways as (
  select hierarchy, l.parent as node, l.parent as root, 0 as depth, l.parent as path from (select distinct hierarchy, parent from links) l anti join links x on x.hierarchy = l.hierarchy and x.node = l.parent
  union all select links.hierarchy, links.node, root, depth + 1, path || '/' || links.node from ways join links on links.hierarchy = ways.hierarchy and links.parent = ways.node)"""

_SNAP = f"""one as (
  select snapshot_no, id, r.p as p, r.l as l from (select snapshot_no, id, max({{'at': delivered_at, 'p': {sql_path('file_path')}, 'l': start_line}}) as r from snapshots group by 1, 2)),
turns as (select snapshot_no as old, lead(snapshot_no) over (order by snapshot_no) as new from (select distinct snapshot_no from snapshots)),
was as (select new as no, one.* from one join turns on old = snapshot_no where new is not null),
now as (select new as no, one.* from one join turns on new = snapshot_no),
diff as (
  select coalesce(now.no, was.no) as snapshot_no, coalesce(now.id, was.id) as id,
    case when was.id is null then 'added' when now.id is null then 'removed' else 'changed' end as change
  from now full join was on was.no = now.no and was.id = now.id
  where was.id is null or now.id is null or was.p is distinct from now.p or was.l is distinct from now.l)"""

ORACLE = {
    "p1_found": f"with {_FIRST} select type, target from first_edges group by 1, 2 having count(*) >= 0.01 * (select count(*) from first_edges)",
    "p1_pairs": f"""with {_FIRST} select type, target, count(*) as n_edges,
  min(weight) as weight_min, list_sort(list(weight) filter (weight is not null))[greatest(1, ceil(0.5 * count(weight)))::int] as weight_p50,
  list_sort(list(weight) filter (weight is not null))[greatest(1, ceil(0.9 * count(weight)))::int] as weight_p90, max(weight) as weight_max,
  count(distinct source) as n_callers, count(distinct file_path) as n_files from first_edges group by 1, 2""",
    "p2_found": f"with {_ORPHANS} select edge_id, side, reason from orphans",
    "p2_counts": f"with {_ORPHANS} select side, strftime(t at time zone 'UTC', '%Y-%m') as period, reason, count(*) as n_refs from orphans group by 1, 2, 3",
    "p3_found": f"with {_CHANGED} select run_id, file_path from changed",
    "p3_counts": f"with {_CHANGED}, firsts as (select *, row_number() over (partition by file_path order by run_id) as k from changed) select run_id, count(*) as n_files, count(*) filter (k = 1) as n_first from firsts group by 1",
    "p4_found": f"""with recursive {_UP} select links.hierarchy, links.node as node_id, coalesce(root, '') as root_id, cast(coalesce(depth, -1) as int) as depth
  from links left join ways on ways.hierarchy = links.hierarchy and ways.node = links.node""",
    "p4_hierarchy": f"""with recursive {_UP}, up as (
  select hierarchy, node, node as above, depth from ways union all select up.hierarchy, up.node, links.parent, up.depth from up join links on links.hierarchy = up.hierarchy and links.node = up.above),
  below as (select hierarchy, above as node, count(*) - 1 as n from up group by 1, 2),
  members as (select hierarchy, node from links union select hierarchy, parent from links)
  select m.hierarchy, m.node as node_id, coalesce(root, '') as root_id, cast(coalesce(depth, -1) as int) as depth, n as n_descendants
  from members m left join ways using (hierarchy, node) left join below using (hierarchy, node)""",
    "p4_paths": f"with recursive {_UP} select hierarchy, node as node_id, path from ways",
    "p4_descendants": f"""with recursive {_UP}, up as (
  select hierarchy, node, parent as above from (select links.* from links join ways using (hierarchy, node)) union all select up.hierarchy, up.node, links.parent from up join links on links.hierarchy = up.hierarchy and links.node = up.above)
  select hierarchy, above as node_id, node as descendant_id from up""",
    "p4_all_paths": f"""with recursive {_UP}, members as (select hierarchy, node from links union select hierarchy, parent from links)
  select hierarchy, node as node_id, path from members left join ways using (hierarchy, node)""",
    "p5_found": f"with {_SNAP} select snapshot_no, id, change from diff",
    "p5_counts": f"with {_SNAP} select snapshot_no, change, count(*) as n_ids from diff group by 1, 2",
}
