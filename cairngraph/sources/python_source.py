"""Python source trees read into raw nodes and edges."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairngraph.functions.paths import is_generated, is_skipped, is_test, module_of
from cairngraph.workspace import empty_files

RAW = "kind string, id string, type string, name string, start_line int, end_line int, metadata string, source string, target string, context string, line_number int, type_only boolean"


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """file_path (relative), text of each Python file below ``root``; hidden and build directories are skipped."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").load(root)
    # Spark makes no row of an empty file; the listing knows its name all the same.
    empty = spark.createDataFrame([(p,) for p in empty_files(spark, root, ".py")], "path string")
    files = found.select("path", "content").unionByName(empty.withColumn("content", F.lit(b"")))
    base = root.removeprefix("file://").rstrip("/") + "/"
    path = F.element_at(F.split(F.regexp_replace("path", "^file:/*", "/"), F.lit("\\Q" + base + "\\E")), -1)
    rows = files.select(path.alias("file_path"), F.col("content").cast("string").alias("text"))
    return rows.where(~is_skipped("file_path"))


class _Reader(ast.NodeVisitor):
    """Symbols and raw references of one module; targets are names, to be linked later."""

    def __init__(self, module: str):
        self.module, self.rows, self.stack, self.classes = module, [], [module], [None]
        self.typing = 0

    def node(self, kind: str, name: str, at: ast.AST, meta: dict) -> str:
        i = f"{self.stack[-1]}.{name}"
        self.rows.append(("node", i, kind, name, at.lineno, at.end_lineno or at.lineno, json.dumps(meta, sort_keys=True), None, None, None, None, None))
        self.edge("DECLARES" if kind == "METHOD" else "CONTAINS", i, at)
        return i

    def edge(self, kind: str, target: str, at: ast.AST, context: str | None = None) -> None:
        self.rows.append(("edge", None, kind, None, None, None, None, self.stack[-1], target, context, at.lineno, self.typing > 0))

    def inside(self, i: str, body: list[ast.AST], owner: str | None) -> None:
        self.stack.append(i)
        self.classes.append(owner)
        for x in body:
            self.visit(x)
        self.stack.pop()
        self.classes.pop()

    def visit_ClassDef(self, n: ast.ClassDef) -> None:
        bases = [b for b in map(_dotted, n.bases) if b]
        abstract = any(b.rsplit(".", 1)[-1] in ("ABC", "Protocol") for b in bases)
        i = self.node("CLASS", n.name, n, {"is_abstract": True} if abstract else {})
        self.stack.append(i)
        for b in bases:
            self.edge("EXTENDS", f"raw_class:{b}", n)
        self.stack.pop()
        self.inside(i, n.body, i)

    def visit_FunctionDef(self, n: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        method = self.classes[-1] is not None
        meta: dict = {}
        if method:
            mine = n.args.args[0].arg if n.args.args else None
            meta["self_attrs"] = sorted({x.attr for x in ast.walk(n) if isinstance(x, ast.Attribute) and isinstance(x.value, ast.Name) and x.value.id == mine})
        decorators = [d for d in (_dotted(x.func if isinstance(x, ast.Call) else x) for x in n.decorator_list) if d]
        if decorators:
            meta["decorators"] = decorators
        if any(d.rsplit(".", 1)[-1] == "abstractmethod" for d in decorators):
            meta["is_abstract"] = True
        i = self.node("METHOD" if method else "FUNCTION", n.name, n, meta)
        self.inside(i, [*n.decorator_list, *n.body], None)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_If(self, n: ast.If) -> None:
        guard = (_dotted(n.test) or "").rsplit(".", 1)[-1] == "TYPE_CHECKING"
        self.typing += guard
        for x in n.body:
            self.visit(x)
        self.typing -= guard
        for x in [n.test, *n.orelse]:
            self.visit(x)

    def visit_Import(self, n: ast.Import) -> None:
        for a in n.names:
            self.edge("IMPORTS", f"raw_import:{a.name}", n, a.asname)

    def visit_ImportFrom(self, n: ast.ImportFrom) -> None:
        parts = self.module.split(".")
        base = ".".join([*(parts[: len(parts) - n.level] if n.level else []), *([n.module] if n.module else [])])
        if base:
            self.edge("IMPORTS", f"raw_import:{base}", n)
        for a in n.names:
            if a.name != "*":
                self.edge("IMPORTS_SYMBOL", f"raw_import:{base}.{a.name}" if base else f"raw_import:{a.name}", n, a.asname)

    def visit_Call(self, n: ast.Call) -> None:
        name = _dotted(n.func)
        if name:
            self.edge("CALLS", name if name.startswith("self.") else f"raw_call:{name}", n)
        for a in [*n.args, *(k.value for k in n.keywords)]:
            if isinstance(a, ast.Name):
                self.edge("REFERENCES", f"raw_call:{a.id}", n, "value-arg:" + (name or ""))
        self.generic_visit(n)


def _dotted(n: ast.AST) -> str | None:
    parts = []
    while isinstance(n, ast.Attribute):
        parts.append(n.attr)
        n = n.value
    return ".".join([n.id, *reversed(parts)]) if isinstance(n, ast.Name) else None


def parse(module: str, text: str) -> list[tuple]:
    """Rows of RAW; a text that is no Python gives its file and nothing in it."""
    lines = text.count("\n") + 1
    top = ("node", module, "FILE", module.rsplit(".", 1)[-1], 1, lines, "{}", None, None, None, None, None)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [top]
    reader = _Reader(module)
    for x in tree.body:
        reader.visit(x)
    return [top, *reader.rows]


def extract(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw nodes and edges of files (file_path, text). Null texts are left out; targets are still names."""
    columns = [c.split()[0] for c in RAW.split(", ")]

    def run(batches):
        for b in batches:
            found = [(p, t, g, *row) for p, m, t, g, text in zip(b["file_path"], b["module"], b["test"], b["generated"], b["text"]) for row in parse(m, text)]
            yield pd.DataFrame(found, columns=["file_path", "is_test", "is_generated", *columns]).astype({c: "Int32" for c in ("start_line", "end_line", "line_number")})

    rows = files.where("file_path is not null and text is not null").select("file_path", module_of("file_path").alias("module"), is_test("file_path").alias("test"), is_generated("text").alias("generated"), "text")
    raw = rows.mapInPandas(run, "file_path string, is_test boolean, is_generated boolean, " + RAW)
    nodes = raw.where("kind = 'node'").select("id", "type", "name", "file_path", "start_line", "end_line", F.lit("python").alias("language"), F.lit(1.0).alias("confidence_score"), "metadata", F.lit("INTERNAL").alias("namespace"), "is_test", "is_generated").dropDuplicates(["id"])
    key = F.concat_ws("|", "type", "source", "target", "file_path", "line_number")
    edges = raw.where("kind = 'edge'").select(F.sha1(key).alias("id"), "source", "target", "type", F.lit(1.0).alias("weight"), F.lit(1.0).alias("confidence"), "context", "file_path", "line_number", F.coalesce("type_only", F.lit(False)).alias("type_only"))
    return nodes, edges.dropDuplicates(["id"])


def link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with their targets linked to nodes where one rule does: raw names become ids, the rest stay names at 0.8.

    In order: a call on self to a method of the class; a name defined in the same module; a name the
    module imported; the whole dotted id. Imports and bases that nothing resolves keep 0.5.
    """
    ids = nodes.select(F.col("id").alias("found"))
    name = F.regexp_replace("target", r"^raw_(call|class|import):", "")
    e = edges.withColumn("name", name).join(nodes.select(F.col("id").alias("source"), F.col("file_path").alias("_f")), "source", "left")
    module = nodes.where("type = 'FILE'").select(F.col("file_path").alias("_f"), F.col("id").alias("module"))
    e = e.join(module, "_f", "left")
    head, tail = F.substring_index("name", ".", 1), F.expr("substring(name, length(substring_index(name, '.', 1)) + 1)")
    imported = edges.where("type in ('IMPORTS', 'IMPORTS_SYMBOL') and target like 'raw_import:%'").withColumn("full", F.substr("target", F.lit(12)))
    known_as = imported.select(F.col("file_path"), F.coalesce("context", F.when(F.col("type") == "IMPORTS", F.col("full")).otherwise(F.element_at(F.split("full", "[.]"), -1))).alias("head"), "full").groupBy("file_path", "head").agg(F.min("full").alias("full"))
    e = e.withColumn("head", head).join(known_as, ["file_path", "head"], "left")
    owner = F.expr("substring(source, 1, length(source) - length(substring_index(source, '.', -1)) - 1)")
    tries = F.array(F.when(F.col("target").startswith("self."), F.concat(owner, F.lit("."), F.expr("substring(target, 6)"))), F.when(~F.col("target").startswith("raw_import:"), F.concat("module", F.lit("."), "name")), F.concat("full", tail), F.col("name"))
    asked = e.select("id", F.posexplode(tries).alias("nth", "found")).where("found is not null").join(ids, "found", "left_semi")
    best = asked.groupBy("id").agg(F.min_by("found", "nth").alias("found"))
    out = e.join(best, "id", "left")
    raw = F.col("target").startswith("raw_") | F.col("target").startswith("self.")
    sure = F.when(~raw, F.col("confidence")).when(F.col("found").isNotNull(), 1.0).when(F.col("target").startswith("raw_class:"), 0.5).otherwise(0.8)
    return out.select("id", "source", F.when(raw, F.coalesce("found", "target")).otherwise(F.col("target")).alias("target"), "type", "weight", sure.alias("confidence"), "context", "file_path", "line_number", "type_only")
