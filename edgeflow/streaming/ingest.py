"""An edge log as a stream: running statistics and degrees (an extension of the batch operators).

Sums and maxima are streaming aggregates with state by key, so a late or repeated
micro-batch is handled by Spark's own checkpoint; nothing is kept on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeflow.sources.text import parse_lines


def text_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Edges of text files as they arrive in a folder."""
    return parse_lines(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder))


def running_stats(edges: DataFrame) -> DataFrame:
    """``max_x, max_y, edges, nodes`` so far."""
    s = edges.groupBy().agg(F.max("src").alias("max_x"), F.max("dst").alias("max_y"), F.count("*").alias("edges"))
    return s.withColumn("nodes", F.greatest("max_x", "max_y") + 1)


def running_degrees(edges: DataFrame) -> DataFrame:
    """``id, deg`` so far."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"))


def windowed_degrees(edges: DataFrame, time: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``window, id, deg`` per window of event time; state older than the watermark is dropped."""
    timed = edges.withWatermark(time, late)
    return timed.groupBy(F.window(time, width), F.col("src").alias("id")).agg(F.count("*").alias("deg"))
