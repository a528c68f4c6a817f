"""Failure clusters over a growing JSON-lines folder, as a stream. An extension of our own: nothing that
this engine models streams by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import shaped_reason
from tessera.sources.logs import FAILURES


def read_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Failure records as they are appended; ``at`` is their time."""
    return spark.readStream.schema(FAILURES).json(folder).withColumn("at", F.to_timestamp("ts"))


def windowed_clusters(failures: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """AG-11 by window of event time; records later than the watermark are left out, and a record that is
    written twice within it counts once."""
    once = failures.withWatermark("at", late).dropDuplicatesWithinWatermark(["ts", "kind", "tool", "reason", "spec"])
    g = once.groupBy(F.window("at", window), "kind", "tool", shaped_reason(F.col("reason")).alias("reason")).agg(F.count("*").alias("n"), F.approx_count_distinct("spec").alias("specs"))
    return g.select("window.start", "window.end", "kind", "tool", "reason", "n", "specs")
