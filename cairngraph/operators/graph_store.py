"""A graph kept in a folder, changed in one step: whole writes, batches of files, types replaced, state.

Nodes and edges lie in folders of their own, written anew by each change; one small file, made in one step, names
those that count. A reader sees the graph before a change or after it. Of two changes made at the same time
one is refused. Edges are parted by type, so that replacing a type rewrites only that; the parts of other types are named anew as they are.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairngraph.operators.skew import extent, sized_join
from cairngraph.schema import EXTERNAL_PATH
from cairngraph.workspace import delete, listing, publish, read_text

# Keys of the state that only the store writes; node and edge types that the uplift makes.
RESERVED = frozenset({"last_ingest", "ingest_options", "data_keys", "fingerprint"})
UPLIFT_NODES, UPLIFT_EDGES = ["DOMAIN_CONCEPT"], ["DOMAIN_DEPENDS_ON"]


class Refused(RuntimeError):
    """Another change was made first."""


@dataclass(frozen=True)
class Version:
    """The folders that count: of nodes, of edges by type, of file hashes; and the state."""

    number: int = 0
    nodes: str | None = None
    edges: dict[str, str] = field(default_factory=dict)
    files: str | None = None
    state: dict[str, object] = field(default_factory=dict)


class GraphStore:
    """nodes (id, file_path, ...), edges (id, source, type, file_path, ...) and files (file_path, hash); columns are the first write's."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def version(self) -> Version:
        done = [x for x in listing(self.spark, f"{self.folder}/version") if x.endswith(".json")]
        return Version(**json.loads(read_text(self.spark, f"{self.folder}/version/{done[-1]}"))) if done else Version()

    def _publish(self, v: Version) -> int:
        text = json.dumps(v.__dict__, sort_keys=True)
        if not publish(self.spark, f"{self.folder}/version/{v.number:010d}.json", text):
            raise Refused(f"version {v.number} was made by another change")
        return v.number

    def _write(self, df: DataFrame, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{name}")
        return name

    def _write_edges(self, edges: DataFrame) -> dict[str, str]:
        name = f"edges-{uuid.uuid4().hex}"
        # ``kind`` parts the folder; ``type`` stays a column of the rows.
        edges.withColumn("kind", F.col("type")).write.partitionBy("kind").parquet(f"{self.folder}/{name}")
        return {x.removeprefix("kind="): f"{name}/{x}" for x in listing(self.spark, f"{self.folder}/{name}") if x.startswith("kind=")}

    def nodes(self, v: Version | None = None) -> DataFrame | None:
        v = v or self.version()
        return self.spark.read.parquet(f"{self.folder}/{v.nodes}") if v.nodes else None

    def edges(self, *types: str, v: Version | None = None) -> DataFrame | None:
        """Edges, or those of some types: no file of another type is opened."""
        v = v or self.version()
        paths = [f"{self.folder}/{p}" for t, p in sorted(v.edges.items()) if not types or t in types]
        return self.spark.read.parquet(*paths) if paths else None

    def files(self, v: Version | None = None) -> DataFrame:
        v = v or self.version()
        return self.spark.read.parquet(f"{self.folder}/{v.files}") if v.files else self.spark.createDataFrame([], "file_path string, hash string")

    def save(self, nodes: DataFrame, edges: DataFrame, files: DataFrame | None = None) -> int:
        """The whole graph in place of what was; the state stays."""
        v = self.version()
        hashes = self._write(files.select("file_path", "hash"), "files") if files is not None else v.files
        return self._publish(Version(v.number + 1, self._write(nodes, "nodes"), self._write_edges(edges), hashes, v.state))

    def save_batch(self, nodes: DataFrame, edges: DataFrame, files: DataFrame, gone: DataFrame | None = None, state: dict[str, object] | None = None) -> int:
        """Files parsed anew: what they and the files in ``gone`` (file_path) had goes, ``nodes`` and ``edges`` come, hashes and state follow, in one step.

        Edges go with their source node or their own file. Nodes of outside code are of no file and stay; where
        ``nodes`` has their ids, it replaces them.
        """
        v = self.version()
        if v.nodes is None:
            return self._publish(Version(v.number + 1, self._write(nodes, "nodes"), self._write_edges(edges), self._write(files.select("file_path", "hash"), "files"), {**v.state, **(state or {})}))
        out = files.select("file_path") if gone is None else files.select("file_path").unionByName(gone.select("file_path"))
        scratch = self._write(out.where(F.col("file_path") != EXTERNAL_PATH).distinct(), "scratch")
        out = self.spark.read.parquet(f"{self.folder}/{scratch}")
        old_nodes, old_edges = self.nodes(v), self.edges(v=v)
        few = lambda d, small, on: sized_join(d, small, [on], "left_anti", extent(small))
        kept = few(old_nodes, out, "file_path")
        kept = few(kept, nodes.select("id").distinct(), "id")
        dead = sized_join(old_nodes, out, ["file_path"], "left_semi", extent(out)).select(F.col("id").alias("source")).distinct()
        all_nodes = self._write(kept.unionByName(nodes), "nodes")
        parts = v.edges
        if old_edges is not None:
            left = few(few(few(old_edges, dead, "source"), out, "file_path"), edges.select("id").distinct(), "id")
            parts = self._write_edges(left.unionByName(edges))
        elif edges.take(1):
            parts = self._write_edges(edges)
        hashes = self._write(few(self.files(v), out, "file_path").unionByName(files.select("file_path", "hash")), "files")
        number = self._publish(Version(v.number + 1, all_nodes, parts, hashes, {**v.state, **(state or {})}))
        delete(self.spark, f"{self.folder}/{scratch}")
        return number

    def replace_type(self, kind: str, edges: DataFrame) -> int:
        """All edges of a type in place of those that were; no other type is read or written."""
        v = self.version()
        made = self._write_edges(edges.where(F.col("type") == kind))
        return self._publish(Version(v.number + 1, v.nodes, {**{t: p for t, p in v.edges.items() if t != kind}, **made}, v.files, v.state))

    def drop_uplift(self) -> int:
        """Without the concepts and dependencies of domains."""
        v = self.version()
        nodes = v.nodes and self._write(self.nodes(v).where(~F.col("type").isin(*UPLIFT_NODES)), "nodes")
        return self._publish(Version(v.number + 1, nodes, {t: p for t, p in v.edges.items() if t not in UPLIFT_EDGES}, v.files, v.state))

    def clear(self) -> int:
        return self._publish(Version(self.version().number + 1))

    def record(self, key: str, value: object) -> int:
        """A value of the state, as JSON with sorted keys; the store's own keys are refused."""
        if key in RESERVED:
            raise ValueError(f"{key} is the store's own")
        return self._record(key, value)

    def _record(self, key: str, value: object) -> int:
        v = self.version()
        return self._publish(Version(v.number + 1, v.nodes, v.edges, v.files, {**v.state, key: json.loads(json.dumps(value, sort_keys=True))}))

    def state(self, key: str, default: object = None) -> object:
        return self.version().state.get(key, default)

    def record_ingest(self, root: str, mark: float, sources: list[str] = (), data_keys: bool = False) -> int:
        """Where the graph was read from, with which options, and the mark files are compared with, in one step."""
        v = self.version()
        state = {**v.state, "last_ingest": {"root": root, "mark": mark}, "ingest_options": sorted(sources), "data_keys": data_keys}
        return self._publish(Version(v.number + 1, v.nodes, v.edges, v.files, state))

    def sweep(self) -> None:
        """Delete the folders that no longer count; not while a change is being made or an older version read."""
        v = self.version()
        kept = {v.nodes, v.files, *(p.split("/")[0] for p in v.edges.values()), "version"}
        for x in listing(self.spark, self.folder):
            if x not in kept:
                delete(self.spark, f"{self.folder}/{x}")


def ingest_mark(times: DataFrame, began: float, now: float) -> DataFrame:
    """One row, mark: the latest ``mtime`` of the files read, but just below the earliest that moved since ``began``, and never after ``now``.

    So a file that changed while it was being read counts as stale the next time. Without files the mark is ``began``.
    """
    s = times.agg(F.max(F.when(F.col("mtime") <= began, F.col("mtime"))).alias("most"), F.min(F.when(F.col("mtime") > began, F.col("mtime"))).alias("moved"), F.count("mtime").alias("n"))
    row = s.first()
    mark = began if not row["n"] else row["most"] if row["moved"] is None else math.nextafter(row["moved"], -math.inf)
    return times.sparkSession.createDataFrame([(float(min(mark, now)),)], "mark double")


def stale_files(tracked: DataFrame, found: DataFrame, mark: float) -> DataFrame:
    """file_path, why (changed, missing, new): tracked files that moved after ``mark`` or are not found, and found ones (file_path, mtime) that are not tracked."""
    both = tracked.select("file_path", F.lit(True).alias("known")).join(found.select("file_path", "mtime"), "file_path", "full")
    why = F.when(F.col("mtime").isNull(), "missing").when(F.col("known").isNull(), "new").when(F.col("mtime") > mark, "changed")
    return both.select("file_path", why.alias("why")).where("why is not null")


def migrated(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """A table of an older layout with the columns it lacks (name to type and default); what it has stays, also columns unknown here."""
    for name, (kind, default) in columns.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(default).cast(kind))
    return df
