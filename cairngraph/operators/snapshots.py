"""What changed between consecutive full snapshots.

Keys get persistent ordinals. A snapshot is then, for each chunk of ordinals, a compressed bitmap of
the keys present and vectors of their columns in ordinal order. AND-NOT of two bitmaps gives what was
added or removed, AND the common keys, whose vectors are compared place by place. A store keeps ordinals
and chunks between runs: a new snapshot is cut into chunks once and compared with the one before it.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairngraph.functions.text import clean_path
from cairngraph.workspace import Workspace, listing, publish, read_text

#: Ordinals of one chunk: the most rows of a snapshot that one task must hold at a time.
CHUNK = 8192


def pack(places: np.ndarray, chunk: int) -> bytes:
    """A chunk's bitmap in the smallest of three containers, as the first byte says: places, runs or plain bits."""
    places = np.unique(np.asarray(places, dtype=np.int64))
    starts = places[np.r_[True, np.diff(places) > 1]] if len(places) else places
    ends = places[np.r_[np.diff(places) > 1, True]] if len(places) else places
    forms = {b"P": places.astype("<u4").tobytes(), b"R": np.stack([starts, ends + 1]).astype("<u4").tobytes()}
    bits = np.zeros(chunk, dtype=bool)
    bits[places] = True
    forms[b"B"] = np.packbits(bits).tobytes()
    return min((k + v for k, v in forms.items()), key=len)


def unpack(packed: bytes | None, chunk: int) -> np.ndarray:
    """The bitmap as booleans; null is an empty one."""
    bits = np.zeros(chunk, dtype=bool)
    if packed is None or len(packed) < 2:
        return bits
    kind, body = packed[:1], packed[1:]
    if kind == b"B":
        return np.unpackbits(np.frombuffer(body, dtype=np.uint8), count=chunk).astype(bool)
    numbers = np.frombuffer(body, dtype="<u4").astype(np.int64)
    if kind == b"P":
        bits[numbers] = True
    else:
        change = np.zeros(chunk + 1, dtype=np.int64)
        half = len(numbers) // 2
        np.add.at(change, numbers[:half], 1)
        np.add.at(change, numbers[half:], -1)
        bits = np.cumsum(change)[:chunk] > 0
    return bits


def key_ordinals(keys: DataFrame, known: DataFrame | None, work: Workspace, fresh_only: bool = False) -> DataFrame:
    """key, ordinal: those of ``known`` as they are, new keys numbered from the next one on, without gaps; with ``fresh_only`` the new ones alone."""
    keys = keys.where("key is not null").distinct()
    start = 0
    if known is not None:
        keys = keys.join(known, "key", "left_anti")
        top = known.agg(F.max("ordinal")).first()[0]
        start = 0 if top is None else top + 1
    new = work.save(keys.withColumn("_at", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id()))
    sizes = new.groupBy("_at").agg(F.count("*").alias("_n"), F.min("_nth").alias("_low"))
    # As many rows as there are partitions.
    bounds = sizes.select("_at", "_low", (F.coalesce(F.sum("_n").over(Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + start).alias("_from"))
    out = new.join(F.broadcast(bounds), "_at").select("key", (F.col("_nth") - F.col("_low") + F.col("_from")).alias("ordinal"))
    return out if fresh_only else work.save(out if known is None else known.select("key", "ordinal").unionByName(out))


def snapshot_chunks(rows: DataFrame, values: list[str], chunk: int = CHUNK) -> DataFrame:
    """snapshot, chunk, bitmap and one aligned vector for each of ``values``, from snapshot, ordinal and values."""
    entry = F.struct((F.col("ordinal") % chunk).cast("int").alias("place"), *values)
    got = rows.groupBy("snapshot", F.floor(F.col("ordinal") / chunk).alias("chunk")).agg(F.array_sort(F.collect_list(entry)).alias("e"))

    @F.pandas_udf("binary")
    def packed(places: pd.Series) -> pd.Series:
        return places.map(lambda x: pack(x, chunk))

    return got.select("snapshot", "chunk", packed("e.place").alias("bitmap"), *[F.col(f"e.{v}").alias(v) for v in values])


def chunk_changes(pairs: DataFrame, values: list[str], chunk: int) -> DataFrame:
    """snapshot, ordinal, change from the chunks of consecutive snapshots side by side (``old_`` and ``new_``)."""

    def compare(batches):
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                was, now = unpack(row.old_bitmap, chunk), unpack(row.new_bitmap, chunk)
                kinds = [("added", np.flatnonzero(now & ~was)), ("removed", np.flatnonzero(was & ~now))]
                common = np.flatnonzero(was & now)
                if len(common):
                    # Where a common key's values stand in either vector: how many keys are before it.
                    i, j = np.cumsum(was)[common] - 1, np.cumsum(now)[common] - 1
                    differs = np.zeros(len(common), dtype=bool)
                    for v in values:
                        a, b = (np.asarray(getattr(row, f"{side}_{v}"), dtype=object) for side in ("old", "new"))
                        differs |= a[i] != b[j]
                    kinds.append(("changed", common[differs]))
                for kind, places in kinds:
                    if len(places):
                        found.append(pd.DataFrame({"snapshot": row.snapshot, "ordinal": places + int(row.chunk) * chunk, "change": kind}))
            if found:
                yield pd.concat(found, ignore_index=True)

    return pairs.mapInPandas(compare, "snapshot int, ordinal long, change string")


class SnapshotStore:
    """Snapshots in a folder: ordinals of all keys ever seen, and the chunks and changes of each snapshot.

    ``add`` writes its data to folders of their own; one file, made in one step, then names them all.
    Of two that add at the same time one fails, and what a failed one wrote is read by no one.
    """

    def __init__(self, spark: SparkSession, folder: str, values: list[str], chunk: int = CHUNK):
        self.spark, self.folder, self.values, self.chunk = spark, folder.rstrip("/"), values, chunk

    def _said(self, number: int) -> dict:
        return json.loads(read_text(self.spark, f"{self.folder}/commit/{number:010d}.json"))

    def last(self) -> dict:
        done = [x for x in listing(self.spark, f"{self.folder}/commit") if x.endswith(".json")]
        return self._said(int(done[-1].removesuffix(".json"))) if done else {"number": 0, "ordinals": [], "snapshots": [], "chunks": None, "changes": None}

    def ordinals(self, said: dict | None = None) -> DataFrame:
        said = said or self.last()
        paths = [f"{self.folder}/{x}" for x in said["ordinals"]]
        return self.spark.read.schema("key string, ordinal long").parquet(*paths) if paths else self.spark.createDataFrame([], "key string, ordinal long")

    def _chunks(self, name: str) -> DataFrame:
        kinds = "".join(f", {v} array<string>" for v in self.values)
        return self.spark.read.schema("chunk long, bitmap binary" + kinds + ", snapshot int").parquet(f"{self.folder}/{name}")

    def add(self, rows: DataFrame, work: Workspace) -> int:
        """Add snapshots (snapshot, key, the values as text; one row for each key of a snapshot); the number of this addition.

        Each is compared with the next lower number, be it stored or added with it. A number not above
        all that are stored is refused: snapshots come whole and in order.
        """
        last = self.last()
        # The snapshots' numbers: as few as deliveries, and no data.
        new = sorted(r[0] for r in rows.select("snapshot").distinct().toLocalIterator())
        if new and last["snapshots"] and new[0] <= last["snapshots"][-1]:
            raise ValueError(f"snapshot {new[0]} is not above {last['snapshots'][-1]}")
        made = {k: f"{k}-{uuid.uuid4().hex}" for k in ("ordinals", "chunks", "changes")}
        at = {k: f"{self.folder}/{v}" for k, v in made.items()}
        known = self.ordinals(last)
        key_ordinals(rows.select("key"), known if last["ordinals"] else None, work, fresh_only=True).write.parquet(at["ordinals"])
        said = {"number": last["number"] + 1, "ordinals": [*last["ordinals"], made["ordinals"]], "snapshots": [*last["snapshots"], *new], "chunks": made["chunks"] if new else last["chunks"], "changes": made["changes"]}
        every = self.ordinals(said)
        snapshot_chunks(rows.join(every, "key").select("snapshot", "ordinal", *self.values), self.values, self.chunk).write.partitionBy("snapshot").parquet(at["chunks"])
        chunks = self._chunks(made["chunks"]) if new else None
        if new and last["snapshots"]:
            chunks = self._chunks(last["chunks"]).where(F.col("snapshot") == last["snapshots"][-1]).unionByName(chunks)
        pairs = list(zip(said["snapshots"], said["snapshots"][1:]))[max(0, len(last["snapshots"]) - 1) :]
        if pairs and new:
            numbers = self.spark.createDataFrame(pairs, "old int, new int")
            side = lambda which: chunks.join(F.broadcast(numbers), F.col("snapshot") == numbers[which]).select(F.col("new").alias("snapshot_"), F.col("chunk").alias("chunk_"), *[F.col(c).alias(f"{which}_{c}") for c in ("bitmap", *self.values)])
            both = side("old").join(side("new"), ["snapshot_", "chunk_"], "full").withColumnsRenamed({"snapshot_": "snapshot", "chunk_": "chunk"})
            found = chunk_changes(both, self.values, self.chunk).join(every, "ordinal").select("snapshot", "key", "change")
        else:
            found = self.spark.createDataFrame([], "snapshot int, key string, change string")
        found.write.parquet(at["changes"])
        if not publish(self.spark, f"{self.folder}/commit/{said['number']:010d}.json", json.dumps(said)):
            raise RuntimeError(f"addition {said['number']} was made by another run")
        return said["number"]

    def changes(self, number: int) -> DataFrame:
        """snapshot, key, change that the addition ``number`` brought."""
        return self.spark.read.schema("snapshot int, key string, change string").parquet(f"{self.folder}/{self._said(number)['changes']}")


def snapshot_changes(rows: DataFrame, snapshot: str, key: str, values: dict[str, Column], latest: str, work: Workspace, folder: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """snapshot_no, id, change (``added``, ``removed``, ``changed``) against the next lower snapshot present.

    Of rows with the same snapshot and key the one with the latest ``latest`` counts (null is
    earliest), of those the greatest by its values, null being least. Rows without snapshot or key
    are left out. Null is a value of its own. The first snapshot is compared with nothing. A ``folder``
    keeps ordinals and chunks: ``rows`` are then the snapshots that are new since. Values are compared as text.
    """
    names = [f"v{i}" for i in range(len(values))]
    picked = rows.select(F.col(snapshot).cast("int").alias("snapshot"), F.col(key).alias("key"), F.col(latest).alias("at"), *[v.cast("string").alias(n) for n, v in zip(names, values.values())]).where("snapshot is not null and key is not null")
    one = picked.groupBy("snapshot", "key").agg(F.max(F.struct("at", *names)).alias("r")).select("snapshot", "key", *[f"r.{n}" for n in names])
    store = SnapshotStore(work.spark, folder or f"{work.root}/snapshots-{uuid.uuid4().hex}", names, chunk)
    found = store.changes(store.add(work.save(one), work))
    return found.select(F.col("snapshot").alias("snapshot_no"), F.col("key").alias("id"), "change")


def graph_changes(snapshots: DataFrame, work: Workspace, folder: str | None = None) -> DataFrame:
    """Nodes added, removed, or with another file_path (as cleaned) or start_line; ``folder`` as in ``snapshot_changes``."""
    return snapshot_changes(snapshots, "snapshot_no", "id", {"file_path": clean_path("file_path"), "start_line": F.col("start_line")}, "delivered_at", work, folder)
