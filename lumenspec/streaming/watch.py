"""Chromatograms of point facets as files arrive: an addition of this engine, built on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspec import schema


def arriving_points(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema.POINTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def running_tic(points: DataFrame) -> DataFrame:
    """Summed and largest intensity of each spectrum so far; combines map-side, state is a row per spectrum."""
    return points.groupBy("spectrum_index").agg(F.sum("intensity").alias("tic"), F.max("intensity").alias("bpc"), F.count("*").alias("n"))


def start(points: DataFrame, name: str, checkpoint: str):
    return running_tic(points).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
