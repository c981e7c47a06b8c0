"""Runs over a log that process each new or changed record once, whatever fails between them.

The log is a sequence of numbered commits. A run reads those between the watermark of the store's last
commit and a limit fixed at its start, so it does not matter what time a record bears or when within
a moment it was written: a log commit is read by exactly one run that succeeds. The run writes
what it decided to a folder of its own; one small file, made in one step that fails for all but
one of several writers, then makes the output, the new state and the watermark visible together. A run
that fails before leaves a folder no one reads, and the next run starts from the same watermark.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairngraph.functions.text import clean_path, lower_word
from cairngraph.operators.skew import BROADCAST_BYTES, extent
from cairngraph.workspace import delete, length, listing, publish, read_text, shared_folder

ENTRY = "key string, content string, seen_at timestamp, seq long"
ROW = ENTRY + ", pending boolean, bucket int"
#: Keys of one bucket of the state, about.
BUCKET_KEYS = 1_000_000
MOST_BUCKETS = 4096


def _number(name: str) -> int:
    return int(name.removesuffix(".json"))


class ChangeLog:
    """An append-only log of reports (ENTRY): numbered commits, each named by a file that is made in one step."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def last(self) -> int:
        return max((_number(x) for x in listing(self.spark, f"{self.folder}/log") if x.endswith(".json")), default=0)

    def append(self, rows: DataFrame) -> int:
        """One more commit with all of ``rows``; its number. Of writers at the same time each gets a number of its own."""
        data = f"data-{uuid.uuid4().hex}"
        rows.select("key", "content", "seen_at", "seq").write.parquet(f"{self.folder}/{data}")
        number = self.last() + 1
        while not publish(self.spark, f"{self.folder}/log/{number:010d}.json", json.dumps({"data": [data]})):
            number += 1
        return number

    def load(self, rows: DataFrame, commit: Column, numbers: range) -> None:
        """A log that has been kept as a table: ``commit`` says of each row with which of ``numbers`` it came."""
        data = f"data-{uuid.uuid4().hex}"
        rows.select("key", "content", "seen_at", "seq", commit.alias("commit")).write.partitionBy("commit").parquet(f"{self.folder}/{data}")
        there = set(listing(self.spark, f"{self.folder}/{data}"))
        for n in numbers:
            part = f"commit={n}"
            if not publish(self.spark, f"{self.folder}/log/{n:010d}.json", json.dumps({"data": [f"{data}/{part}"] if part in there else []})):
                raise RuntimeError(f"log commit {n} is there already")

    def read(self, after: int, upto: int) -> DataFrame:
        """Rows of the commits above ``after`` up to ``upto``; no other file is opened."""
        said = [json.loads(read_text(self.spark, f"{self.folder}/log/{n:010d}.json")) for n in range(after + 1, upto + 1)]
        paths = [f"{self.folder}/{d}" for x in said for d in x["data"]]
        return self.spark.read.schema(ENTRY).parquet(*paths) if paths else self.spark.createDataFrame([], ENTRY)


@dataclass(frozen=True)
class Commit:
    """What a commit's file says: its data, the watermark, since which commit the state counts, and how it is cut.

    ``batches`` has the last batch of each stream that made commits.
    """

    number: int = 0
    watermark: int | datetime | None = None
    base: int = 1
    buckets: int = 1
    data: str = ""
    batches: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        w = self.watermark
        return json.dumps({**self.__dict__, "watermark": {"time": w.isoformat()} if isinstance(w, datetime) else w})

    @classmethod
    def of(cls, text: str) -> Commit:
        said = json.loads(text)
        w = said["watermark"]
        return cls(**{**said, "watermark": datetime.fromisoformat(w["time"]) if isinstance(w, dict) else w})


class ChangeStore:
    """Commits in a folder: ``commit/NNNNNNNNNN.json`` names the data of each, what its run decided.

    The state, the newest record of each key, is the union of the commits since the last compaction;
    each ``compact_every`` commits one rewrites the state, so a run reads a bounded number of them. It
    lies in buckets of the keys, as many as the keys ask for: a run opens those its new records fall
    into, and joins only the keys it has new records of.
    """

    def __init__(self, spark: SparkSession, folder: str, compact_every: int = 8, bucket_keys: int = BUCKET_KEYS):
        self.spark, self.folder, self.compact_every, self.bucket_keys = spark, folder.rstrip("/"), compact_every, bucket_keys
        self._told: dict[int, Commit] = {}

    def last(self) -> Commit:
        done = [x for x in listing(self.spark, f"{self.folder}/commit") if x.endswith(".json")]
        return self.commit(_number(done[-1])) if done else Commit()

    def commit(self, number: int) -> Commit:
        """What a commit says; it never changes, so each is read once."""
        if number not in self._told:
            self._told[number] = Commit.of(read_text(self.spark, f"{self.folder}/commit/{number:010d}.json"))
        return self._told[number]

    def rows(self, first: int, last: int) -> DataFrame:
        paths = [f"{self.folder}/{self.commit(n).data}" for n in range(first, last + 1)]
        out = None
        # Folders of their own, so that each keeps its buckets apart; at most ``compact_every`` of them.
        for p in paths:
            part = self.spark.read.schema(ROW).parquet(p)
            out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], ROW) if out is None else out

    def run(self, log: ChangeLog | DataFrame, sequence: Column | None, limit: int | datetime, before_commit=None) -> int:
        """Process what the log has above the watermark and up to ``limit``; the commit's number.

        A log that is a table instead needs its ``sequence``, a column that never goes back: numbers or times.
        ``before_commit`` may raise, for tests.
        """
        last = self.last()
        if isinstance(log, ChangeLog):
            new = log.read(last.watermark or 0, limit)
        else:
            new = log.where(sequence <= F.lit(limit))
            new = new if last.watermark is None else new.where(sequence > F.lit(last.watermark))
        return self.apply(new, last, limit, before_commit=before_commit)

    def apply(self, new: DataFrame, last: Commit, watermark: int | datetime | None, batches: dict[str, int] | None = None, before_commit=None) -> int:
        """Make the commit after ``last`` from ``new``, which holds what that has not seen and nothing else."""
        number = last.number + 1
        compact = number - last.base >= self.compact_every or not last.number
        buckets = last.buckets
        if compact and last.number:
            buckets = max(1, min(MOST_BUCKETS, -(-self.rows(last.base, last.number).select("key").distinct().count() // self.bucket_keys)))
        bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
        record = F.struct("seen_at", "seq", "content")
        fresh = new.groupBy("key").agg(F.max(record).alias("top")).select("key", "top", bucket.alias("bucket"))
        state, scratch = self.rows(last.base, last.number), None
        if last.number and not compact:
            scratch = f"{self.folder}/new-{uuid.uuid4().hex}"
            fresh.write.parquet(scratch)
            fresh = self.spark.read.schema(fresh.schema).parquet(scratch)
            # A file takes a hundredth of its rows' room at the least; only in doubt are the rows themselves measured.
            small = 100 * length(self.spark, scratch) <= BROADCAST_BYTES or extent(fresh.select("key")).bytes <= BROADCAST_BYTES
            if last.buckets > 1:
                state = state.where(F.col("bucket").isin([r[0] for r in fresh.select("bucket").distinct().toLocalIterator()]))
            asked = fresh.select("key")
            state = state.join(F.broadcast(asked) if small else asked, "key", "left_semi")
        held = state.groupBy("key").agg(F.max(record).alias("old"))
        both = fresh.drop("bucket").join(held, "key", "full" if compact else "left")
        newest = both.select("key", F.greatest("top", "old").alias("now"), "old", F.col("top").isNotNull().alias("touched"))
        changed = F.col("old").isNull() | (F.col("old.content") != F.col("now.content"))
        moved = F.col("old").isNull() | (F.col("now") != F.col("old"))
        rows = (newest if compact else newest.where(moved)).select("key", "now.content", "now.seen_at", "now.seq", (F.col("touched") & (F.col("now.content") != "") & changed).alias("pending"), bucket.alias("bucket"))
        rows = rows.repartition(buckets, "bucket") if buckets > 1 else rows
        data = f"data-{uuid.uuid4().hex}"
        (rows.write.partitionBy("bucket") if buckets > 1 else rows.write).parquet(f"{self.folder}/{data}")
        if scratch:
            delete(self.spark, scratch)
        made = Commit(number, watermark, number if compact else last.base, buckets, data, {**last.batches, **(batches or {})})
        if before_commit:
            before_commit()
        if not publish(self.spark, f"{self.folder}/commit/{number:010d}.json", made.text()):
            delete(self.spark, f"{self.folder}/{data}")
            raise RuntimeError(f"commit {number} was made by another run")
        return number

    def output(self, number: int) -> DataFrame:
        """Keys the commit's run had to process."""
        return self.rows(number, number).where("pending").select("key")

    def sweep(self) -> None:
        """Delete the data of runs that failed; not while a run is going on."""
        kept = {self.commit(_number(x)).data for x in listing(self.spark, f"{self.folder}/commit") if x.endswith(".json")}
        for x in listing(self.spark, self.folder):
            if x.startswith("new-") or (x.startswith("data-") and x not in kept):
                delete(self.spark, f"{self.folder}/{x}")


def file_log(files_state: DataFrame) -> DataFrame:
    """key, content, seen_at, seq, arrived of each report that says something: unread files (null hash) do not."""
    said = files_state.select(clean_path("file_path").alias("key"), lower_word("hash").alias("content"), F.col("scanned_at").alias("seen_at"), F.col("state_id").alias("seq"), "arrived_at")
    return said.where("key is not null and content is not null and seen_at is not null and arrived_at is not null")


def changed_files(files_state: DataFrame, runs: DataFrame, spark: SparkSession, folder: str | None = None) -> DataFrame:
    """run_id, file_path: what each run that succeeded had to process, by running them in order.

    The log has one commit for each start of a run, failed ones included: what arrived up to it since
    the start before. A file counts once a run, at its latest report by scan time, then by state_id. An
    empty hash is content that is not there: it is no case itself, and the next one that is not
    empty is. Runs that failed commit nothing. Runs without a start are left out; without runs there are no rows.
    The runs are a few administrative rows and are read by the driver.
    """
    folder = (folder or f"{shared_folder(spark)}/changes-{uuid.uuid4().hex}").rstrip("/")
    every = runs.where("started_at is not null").select("run_id", F.lower(F.trim("status")).alias("status"), F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("at")).distinct().orderBy("at", "run_id").collect()
    starts = sorted({r["at"] for r in every})
    good = [r for r in every if r["status"] == "ok"]
    if not good:
        return spark.createDataFrame([], "run_id int, file_path string")
    log, store = ChangeLog(spark, f"{folder}/log"), ChangeStore(spark, f"{folder}/store")
    times = F.array(*[F.lit(datetime.fromisoformat(x)) for x in starts])
    number = F.size(F.filter(times, lambda t: t < F.col("arrived_at"))) + 1
    log.load(file_log(files_state).withColumn("_n", number).where(F.col("_n") <= len(starts)), F.col("_n"), range(1, len(starts) + 1))
    out = None
    for run in good:
        made = store.run(log, None, starts.index(run["at"]) + 1)
        part = store.output(made).select(F.lit(run["run_id"]).alias("run_id"), F.col("key").alias("file_path"))
        out = part if out is None else out.unionByName(part)
    return out


def changed_counts(changed: DataFrame) -> DataFrame:
    """run_id, n_files, and n_first: those no run before it had to process."""
    first = F.row_number().over(Window.partitionBy("file_path").orderBy("run_id")) == 1
    return changed.withColumn("_f", first).groupBy("run_id").agg(F.count("*").alias("n_files"), F.count(F.when(F.col("_f"), 1)).alias("n_first"))
