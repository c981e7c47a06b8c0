"""A session for local work; on a cluster the caller brings its own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int = 8, memory: str = "12g", shuffle: int = 8) -> SparkSession:
    conf = {
        "spark.sql.shuffle.partitions": shuffle,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    spark = SparkSession.builder.master(f"local[{cores}]").appName("cairngraph").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
