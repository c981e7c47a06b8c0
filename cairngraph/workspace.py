"""Materialised intermediate tables, in the folder every executor shares.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``. A table read back from there
does not depend on any executor, so a lost one costs a re-read and not a re-run.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Only a local master may do without: all its tasks see one disk. Elsewhere a missing folder is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = set_.get() if set_.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="cairngraph-"))
            atexit.register(shutil.rmtree, _own[0].removeprefix("file://"), ignore_errors=True)
        folder = _own[0]
    return folder.rstrip("/")


class Workspace:
    """A folder for one operator call; ``save`` writes a table and gives it back without lineage.

    The folder goes when it is closed, and at the latest when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0
        self.tables: list[str] = []
        p, fs = _path(spark, self.root)
        fs.mkdirs(p)
        fs.deleteOnExit(p)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Delete every table of this workspace; whatever still reads them fails."""
        for name in self.tables:
            self.spark.sql(f"drop table if exists {name}")
        delete(self.spark, self.root)

    def save(self, df: DataFrame, files: int | None = None) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made:04d}"
        (df.coalesce(files) if files else df).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._cairn_path = path
        return out

    def save_bucketed(self, df: DataFrame, key: str, buckets: int) -> DataFrame:
        """``save`` into buckets of ``key``: joins on it need no exchange of this table. Where the catalog takes no table it is saved plainly."""
        self.made += 1
        path, name = f"{self.root}/{self.made:04d}", f"cairn_{uuid.uuid4().hex}"
        try:
            df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).saveAsTable(name)
        except AnalysisException:
            return self.save(df)
        self.tables.append(name)
        out = self.spark.table(name)
        out._cairn_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            path = getattr(t, "_cairn_path", None)
            if path:
                delete(self.spark, path)


def _path(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def version(spark: SparkSession, path: str) -> tuple:
    """What tells whether a table's files changed: their number, their length and the latest change."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return (0, 0, 0)
    files = [s for s in (fs.listStatus(p) if fs.getFileStatus(p).isDirectory() else [fs.getFileStatus(p)])]
    return (len(files), sum(s.getLen() for s in files), max((s.getModificationTime() for s in files), default=0))


def length(spark: SparkSession, path: str) -> int:
    """Bytes of the files below ``path``."""
    p, fs = _path(spark, path)
    return fs.getContentSummary(p).getLength()


def listing(spark: SparkSession, path: str) -> list[str]:
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p))


def publish(spark: SparkSession, path: str, content: str, linked: bool | None = None) -> bool:
    """Make a small file with all its content in one step; False if there is one already, whoever made it.

    The content is written beside it first. On a local disk a hard link then names it, elsewhere a
    rename that refuses to replace: both fail for all but one of several writers. Any other failure is raised.
    ``linked`` chooses between them; by itself the file system does.
    """
    p, fs = _path(spark, path)
    fs.mkdirs(p.getParent())
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    if linked is None:
        linked = fs.getScheme() == "file"
    if linked:
        own, target = (_path(spark, x)[0].toUri().getPath() for x in (draft, path))
        with open(own, "x", encoding="utf-8") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(own, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
        return True
    jvm = spark._jvm
    q = _path(spark, draft)[0]
    out = fs.create(q, False)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
    refuse = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    refuse[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(q, p, refuse)
    except Py4JJavaError as e:
        fs.delete(q, False)
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _path(spark, path)
    data = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(data)).decode()
    finally:
        data.close()


def empty_files(spark: SparkSession, root: str, ending: str) -> list[str]:
    """Paths of the files of no length below ``root`` whose names end so."""
    p, fs = _path(spark, root)
    found, files = [], fs.listFiles(p, True)
    while files.hasNext():
        f = files.next()
        if f.getLen() == 0 and f.getPath().getName().endswith(ending):
            found.append(f.getPath().toUri().getPath())
    return found
