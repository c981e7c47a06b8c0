"""A stream of file reports that drives the runs of a change store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairngraph.operators.incremental import ChangeStore, file_log

FILES_STATE = "state_id long, file_path string, hash string, scanned_at timestamp, arrived_at timestamp"


def follow(spark: SparkSession, folder: str, store: ChangeStore, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of Parquet files below ``folder`` becomes one commit of ``store``.

    Every commit carries the last batch of each stream, known by its checkpoint. A batch that is given
    again after a failure is not committed twice, whatever other commits the store has.
    """
    stream = spark.readStream.schema(FILES_STATE).parquet(folder)

    def commit(batch: DataFrame, number: int) -> None:
        last = store.last()
        if last.batches.get(checkpoint, -1) >= number:
            return
        # The batch itself is the bound here; the watermark is that of runs over a log.
        store.apply(file_log(batch), last, last.watermark, {checkpoint: number})

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def call_counts(edges: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """window, type, n_edges of a stream of edges by arrival; rows later than ``late`` are dropped by the watermark."""
    return edges.withWatermark("ingested_at", late).groupBy(F.window("ingested_at", window), F.upper(F.trim("type")).alias("type")).agg(F.count("*").alias("n_edges"))
