"""What a change of lines may break: subclasses and callers of changed symbols, and the other sites of changed data keys."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairngraph.functions.paths import is_test
from cairngraph.functions.text import clean_path
from cairngraph.graph import Graph
from cairngraph.operators.keys import COMMON_PARTS, MAX_FILES, span_join
from cairngraph.schema import KEY_TYPES
from cairngraph.workspace import Workspace

# The symbols whose lines count, the order of kinds of equal score, and what is said of a key's sites.
SYMBOLS = ["CLASS", "FUNCTION", "METHOD"]
KINDS = ["removed-declaration", "undeclared-read", "subclass", "caller", "key-writer", "key-declarer", "key-reader"]
KEY_KIND = {"WRITES_KEY": ("key-writer", "writes", "write"), "DECLARES_KEY": ("key-declarer", "declares", "declaration"), "READS_KEY": ("key-reader", "reads", "read")}
DATA_FILE = r"\.(json|ya?ml)$"
LINES = "old_path string, new_path string, side string, line int, text string"

_HUNK = re.compile(r"@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@")


def _path(said: str) -> str | None:
    name = said.split("\t")[0].strip()
    name = name[1:-1] if name.startswith('"') and name.endswith('"') else name
    return None if name == "/dev/null" else re.sub(r"^[ab]/", "", name)


def diff_rows(diff: str) -> Iterator[tuple[str | None, str | None, str | None, int | None, str | None]]:
    """LINES of a unified diff: removed lines (side old), added and context lines (new, context), and one row without a line for each file."""
    old = new = None
    named = inside = False
    was = now = 0
    for line in diff.splitlines():
        if line.startswith("diff --git "):
            if named:
                yield old, new, None, None, None
            both = re.match(r'diff --git "?a/(.*?)"? "?b/(.*?)"?$', line)
            old, new = (both[1], both[2]) if both else (None, None)
            named, inside = True, False
        elif not inside and line.startswith("--- "):
            old, named = _path(line[4:]), True
        elif not inside and line.startswith("+++ "):
            new, named = _path(line[4:]), True
        elif not inside and (line.startswith("rename from ") or line.startswith("rename to ")):
            old, new = (line[12:], new) if line.startswith("rename from ") else (old, line[10:])
        elif not inside and line.startswith("new file"):
            old = None
        elif not inside and line.startswith("deleted file"):
            new = None
        elif m := _HUNK.match(line):
            was, now, inside = int(m[1]), int(m[2]), True
        elif inside and line[:1] == "-":
            yield old, new, "old", was, line[1:]
            was += 1
        elif inside and line[:1] in ("+", " ", ""):
            yield old, new, "new" if line[:1] == "+" else "context", now, line[1:]
            now, was = now + 1, was + (line[:1] != "+")
    if named:
        yield old, new, None, None, None


def parse_diffs(diffs: DataFrame) -> DataFrame:
    """LINES of every unified ``diff``; null texts and texts that are no diffs give no rows."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame([r for d in b["diff"] for r in diff_rows(d)], columns=["old_path", "new_path", "side", "line", "text"]).astype({"line": "Int32"})

    return diffs.select("diff").where("diff is not null").mapInPandas(run, LINES)


def line_index(lines: DataFrame) -> DataFrame:
    """file, line, text of the lines a diff shows of the new files: those a remark can stand on."""
    return lines.where("side in ('new', 'context') and new_path is not null").select(F.col("new_path").alias("file"), "line", "text")


@dataclass(frozen=True)
class Check:
    """items (nth, kind, changed, site, file, line, reason, score, key), cut to the cap, and one row of summary: n_symbols, n_keys, n_items, in_tests."""

    items: DataFrame
    summary: DataFrame


def changed_symbols(g: Graph, lines: DataFrame, base_nodes: DataFrame) -> DataFrame:
    """id, type, name, verb (changed, removed) of the symbols the lines touch.

    A symbol of the graph is changed if its span holds a new line. One of ``base_nodes`` (the nodes as they
    were) is met if its span holds an old line, or if its whole file moved or went; it is removed unless the graph still has its
    id in the same file.
    """
    kinds = F.col("type").isin(*SYMBOLS)
    head = g.nodes.where(kinds)
    new = lines.where("side = 'new' and new_path is not null").select(F.col("new_path").alias("file_path"), "line")
    touched = span_join(head, new).select("id").distinct()
    old = base_nodes.where(kinds).select("id", "type", "name", clean_path("file_path").alias("file_path"), "start_line", "end_line")
    moved = lines.where("old_path is not null and (new_path is null or new_path <> old_path)").select(clean_path("old_path").alias("file_path")).distinct()
    cut = lines.where("side = 'old' and old_path is not null").select(F.col("old_path").alias("file_path"), "line")
    met = span_join(old, cut).select("id").unionByName(old.join(moved, "file_path", "left_semi").select("id")).distinct()
    now = head.select("id", clean_path("file_path").alias("file_path"), F.lit(True).alias("there"))
    met = old.join(met, "id", "left_semi").dropDuplicates(["id"]).join(now, ["id", "file_path"], "left")
    changed = touched.unionByName(met.where("there").select("id")).distinct()
    gone = met.where("there is null").select("id", "type", "name").join(changed, "id", "left_anti")
    return head.join(changed, "id", "left_semi").select("id", "type", "name", F.lit("changed").alias("verb")).unionByName(gone.withColumn("verb", F.lit("removed")))


def symbol_items(g: Graph, symbols: DataFrame) -> DataFrame:
    """kind, changed, site, line, reason, score, key, tier: all subclasses of changed classes, their score falling with the distance, and the callers of the rest.

    Of several edges between the same two the surest counts, then the one of the least line and id. Classes are walked down from all at once.
    """
    work = g.work
    best = lambda: F.max(F.struct("confidence", (-F.coalesce("line_number", F.lit(1 << 30))).alias("near"), F.col("line_number").alias("line"))).alias("e")
    down = work.save(g.typed("EXTENDS").where("source <> target").groupBy(F.col("target").alias("at"), F.col("source").alias("site")).agg(best()))
    front = work.save(symbols.where("type = 'CLASS'").select(F.col("id").alias("changed"), F.col("id").alias("at")))
    seen, found, depth = front.select("changed", F.col("at").alias("site")), [], 0
    while front.take(1):
        depth += 1
        step = front.join(down, "at").groupBy("changed", "site").agg(F.max("e").alias("e")).join(seen, ["changed", "site"], "left_anti")
        step = work.save(step.withColumn("depth", F.lit(depth)))
        found.append(step)
        seen = seen.unionByName(step.select("changed", "site"))
        front = step.select("changed", F.col("site").alias("at"))
    told = symbols.select(F.col("id").alias("changed"), "name", "verb")
    calls = g.meet(g.typed("CALLS").where("source <> target"), symbols.where("type <> 'CLASS'").select(F.col("id").alias("target")), "target", "left_semi")
    calls = calls.groupBy(F.col("target").alias("changed"), F.col("source").alias("site")).agg(best()).join(told, "changed")
    out = calls.select(F.lit("caller").alias("kind"), "changed", "site", "e.line", F.concat(F.lit("calls "), "name", F.lit(", which this diff "), "verb").alias("reason"), F.col("e.confidence").alias("score"))
    for step in found:
        far = F.when(F.col("depth") > 1, F.concat(F.lit(" ("), F.col("depth").cast("string"), F.lit(" levels)"))).otherwise("")
        out = out.unionByName(step.join(told, "changed").select(F.lit("subclass").alias("kind"), "changed", "site", "e.line", F.concat(F.lit("extends "), "name", F.lit(", which this diff "), "verb", far).alias("reason"), (F.col("e.confidence") / F.col("depth")).alias("score")))
    return out.withColumn("key", F.lit("")).withColumn("tier", F.lit(0))


def _split(c: str = "key") -> list[Column]:
    body = F.substr(c, F.lit(5))
    space = F.substring_index(body, "|", 1)
    return [space.alias("namespace"), F.substr(body, F.length(space) + 2).alias("path")]


def key_edges(g: Graph) -> DataFrame:
    """key, namespace, path, type, source, file, line, context of each edge to a data key."""
    e = g.typed(*KEY_TYPES).where(F.col("target").startswith("key:"))
    rows = e.select(F.col("target").alias("key"), "type", "source", F.coalesce(clean_path("file_path"), F.lit("")).alias("file"), F.col("line_number").alias("line"), F.coalesce("context", F.lit("")).alias("context"))
    return rows.select("*", *_split())


def key_facts(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """key, namespace, path, specificity, dropped of all keys of ``edges`` and of ``asked`` (key): files of tests do not count."""
    files = edges.where((F.col("file") != "") & ~is_test("file")).select("key", "file").distinct().groupBy("key").agg(F.count("*").alias("n"))
    rows = edges.select("key").unionByName(asked.select("key")).distinct().select("key", *_split()).join(files, "key", "left").na.fill(0, ["n"])
    scoped, parts = F.col("namespace") != "", F.split("path", "[.]")
    common = F.forall(parts, lambda p: p.isin(*COMMON_PARTS))
    return rows.select("key", "namespace", "path", (F.size(parts) + scoped.cast("int") - F.log2(F.greatest("n", F.lit(1)))).alias("specificity"), (~scoped & (common | (F.col("n") > MAX_FILES))).alias("dropped"))


def _agree(a: str, b: str) -> Column:
    return (F.col(a) == F.col(b)) | (F.col(a) == "") | (F.col(b) == "")


def key_items(edges: DataFrame, uses: DataFrame, renamed: DataFrame, work: Workspace) -> DataFrame:
    """kind, changed, site, line, reason, score, key, tier: where the data of changed keys is used besides.

    ``edges``: those of ``key_edges``. ``uses`` (key, type, source, file, base): the key edges a diff touches, ``base`` those on
    removed lines. ``renamed``: old_path, new_path of files that are still there. Uses in tests do not count.
    Other sites are those of keys that can name the same data, and the readers of what lies inside it. A read is undeclared if a mapping in a data file declares
    its parent and nothing declares it; a declaration is removed if no file declares the key any more.
    """
    edges = work.save(edges)
    uses = work.save(uses.where(~is_test("file")))
    facts = work.save(key_facts(edges, uses))
    word = F.create_map(*[x for k, v in KEY_KIND.items() for x in (F.lit(k), F.lit(v[2]))])
    changed = work.save(uses.groupBy("key").agg(F.collect_set("source").alias("sources"), F.array_join(F.array_sort(F.collect_set(word[F.col("type")])), "/").alias("words")).join(facts, "key"))
    far = facts.select(F.col("key").alias("match"), F.col("namespace").alias("far"), "path", F.col("specificity").alias("far_specificity"), F.col("dropped").alias("far_dropped"))
    same = changed.join(far, "path").where(_agree("namespace", "far")).withColumn("below", F.lit(False))
    parts = F.split("path", "[.]")
    heads = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "."))).otherwise(F.array().cast("array<string>"))
    inner = far.select("match", "far", "far_specificity", "far_dropped", F.explode(heads).alias("path"))
    below = changed.join(inner, "path").where(_agree("namespace", "far")).withColumn("below", F.lit(True))
    live = "not dropped and not far_dropped"
    score = F.least("specificity", "far_specificity")
    show = lambda ns, p: F.when(F.col(ns) != "", F.concat(F.col(p), F.lit(" ("), F.col(ns), F.lit(")"))).otherwise(F.col(p))
    site = edges.select(F.col("key").alias("match"), F.col("path").alias("far_path"), "type", "source", "line")
    matches = same.unionByName(below).where(live).join(site, "match").where(~F.expr("array_contains(sources, source)") & (~F.col("below") | (F.col("type") == "READS_KEY")))
    of = lambda i: F.create_map(*[x for k, v in KEY_KIND.items() for x in (F.lit(k), F.lit(v[i]))])[F.col("type")]
    item = lambda d, kind, by, key, reason, value, tier: d.select(kind.alias("kind"), F.col(by).alias("changed"), F.col("source").alias("site"), "line", reason.alias("reason"), value.alias("score"), F.col(key).alias("key"), tier.alias("tier"))
    others = item(matches, of(0), "key", "match", F.concat(of(1), F.lit(" "), show("far", "far_path"), F.lit("; this diff changes a "), "words", F.lit(" of "), show("namespace", "path")), score, F.lit(0))
    # Declarations: anywhere, and in mappings of data files, where the type of a path may be given.
    declares = edges.where("type = 'DECLARES_KEY'")
    declared = work.save(declares.select("path", F.col("namespace").alias("by"), "file").distinct())
    mapped = work.save(declares.where(F.col("file").rlike(DATA_FILE) & ((F.col("namespace") != "") | (F.col("context") != ""))).select("key", "path", F.col("namespace").alias("by"), "file", "context", "line"))
    reads = edges.where("type = 'READS_KEY'").withColumn("parent", F.regexp_extract("path", r"^(.*)\.[^.]*$", 1))
    asked = uses.where("type = 'READS_KEY' and not base").select("key").distinct()
    head = renamed.select(F.col("old_path").alias("file"), F.col("new_path").alias("now"))
    touched = uses.where("type = 'DECLARES_KEY'").join(head, "file", "left").select(F.when(F.col("base"), F.coalesce("now", "file")).otherwise(F.col("file")).alias("file")).distinct()
    under = mapped.join(touched, "file", "left_semi").select(F.col("path").alias("parent"), "by").distinct()
    candidates = reads.join(asked, "key", "left_semi").unionByName(reads.join(under, "parent").where(_agree("namespace", "by")).select(reads.columns)).distinct().where("parent <> ''")
    above = mapped.select(F.col("path").alias("parent"), "by", F.col("file").alias("holder"), F.col("context").alias("given"))
    held = candidates.join(above, "parent").where(_agree("namespace", "by")).groupBy("key", "namespace", "path", "parent", "source", "line").agg(F.min("holder").alias("holder"), F.max((~F.col("given").isin("", "object")).cast("int")).alias("leaf"))
    own = held.join(declared.drop("file"), "path").where(_agree("namespace", "by")).select("key").distinct()
    missing = held.join(own, "key", "left_anti").join(facts.select("key", "specificity"), "key")
    undeclared = item(missing, F.lit("undeclared-read"), "key", "key", F.concat(F.lit("reads "), "path", F.lit(", but "), "holder", F.lit(" declares "), "parent", F.lit(" with no "), "path"), F.col("specificity"), F.lit(1) - F.col("leaf"))
    gone = uses.where("base and type = 'DECLARES_KEY'").groupBy("key").agg(F.min("file").alias("holder"))
    still = gone.join(facts, "key").join(declared.drop("file"), "path").where(_agree("namespace", "by")).select("key").distinct()
    lost = same.join(gone, "key").join(still, "key", "left_anti").where(live).join(site.where("type = 'READS_KEY'"), "match")
    removed = item(lost, F.lit("removed-declaration"), "key", "match", F.concat(F.lit("reads "), "path", F.lit(", whose declaration in "), "holder", F.lit(" this diff removes")), score, F.lit(0))
    every = work.save(others.unionByName(undeclared).unionByName(removed))
    # A site told of as broken is not told of as a mere user of the same key; then one item a site and kind, the best.
    rank = F.when(F.col("kind") == KINDS[0], 0).when(F.col("kind") == KINDS[1], 1)
    first = every.withColumn("rank", rank).where("rank is not null").groupBy("site", "key").agg(F.min("rank").alias("first"))
    kept = every.withColumn("rank", rank).join(first, ["site", "key"], "left").where("first is null or rank = first")
    best = F.max_by(F.struct("changed", "line", "reason", "score", "key", "tier"), F.struct("score", F.xxhash64("changed", "key")))
    return kept.groupBy("kind", "site").agg(best.alias("b")).select("kind", "b.changed", "site", "b.line", "b.reason", "b.score", "b.key", "b.tier")


def diff_check(g: Graph, lines: DataFrame, base_nodes: DataFrame, base_keys: DataFrame | None = None, cap: int = 5) -> Check:
    """What depends on the symbols and data keys that ``lines`` (as of ``parse_diffs``) touch, likeliest first.

    ``base_nodes``: nodes of the changed files as they were. ``base_keys`` (key, type, source, file_path, line): their key edges. Items
    whose site is no node are left out, those in tests are counted only. The order is by score, kind, tier, file, line and site.
    """
    work = g.work
    lines = work.save(lines)
    symbols = work.save(changed_symbols(g, lines, base_nodes))
    edges = work.save(key_edges(g))
    at = lambda side, path: lines.where(f"side = '{side}' and {path} is not null").select(clean_path(path).alias("file"), "line").distinct()
    uses = edges.join(at("new", "new_path"), ["file", "line"], "left_semi").select("key", "type", "source", "file", F.lit(False).alias("base"))
    if base_keys is not None:
        was = base_keys.where("key like 'key:%'").select("key", "type", "source", clean_path("file_path").alias("file"), "line")
        uses = uses.unionByName(was.join(at("old", "old_path"), ["file", "line"], "left_semi").select("key", "type", "source", "file", F.lit(True).alias("base")))
    uses = work.save(uses)
    renamed = lines.where("old_path is not null and new_path is not null").select(clean_path("old_path").alias("old_path"), clean_path("new_path").alias("new_path")).distinct()
    every = symbol_items(g, symbols).unionByName(key_items(edges, uses, renamed, work))
    sites = g.nodes.select(F.col("id").alias("site"), F.col("file_path").alias("file"), "start_line", "is_test")
    found = work.save(every.join(sites, "site"))
    shown = found.where("not coalesce(is_test, false)").withColumn("line", F.coalesce(F.when(F.col("line") != 0, F.col("line")), "start_line"))
    kinds = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    order = [F.desc("score"), kinds[F.col("kind")], "tier", "file", F.coalesce("line", F.lit(0)), "site", "changed"]
    top = shown.orderBy(*order).limit(cap)
    nth = F.row_number().over(Window.orderBy(*order))  # as many rows as the cap
    items = top.select(nth.alias("nth"), "kind", "changed", "site", "file", "line", "reason", "score", "key")
    counts = found.agg(F.count(F.when(~F.coalesce("is_test", F.lit(False)), 1)).alias("n_items"), F.count(F.when(F.col("is_test"), 1)).alias("in_tests"))
    n_symbols, n_keys = symbols.agg(F.countDistinct("id").alias("n_symbols")), uses.agg(F.countDistinct("key").alias("n_keys"))
    return Check(items, n_symbols.join(n_keys).join(counts))
