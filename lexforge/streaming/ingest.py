"""Ingest as a stream, an extension: texts that arrive in a directory are judged one by one and written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import text as X


def arriving(spark: SparkSession, directory: str, schema: str = "path string, text string") -> DataFrame:
    return spark.readStream.schema(schema).json(directory)


def kept(stream: DataFrame, time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Texts that aren't empty and hold no secret, once each. With a time column, copies are only known within ``delay``."""
    fit = stream.filter((F.col("text") != "") & X.secret_name("text").isNull()).withColumn("sha256", F.sha2("text", 256))
    return fit.dropDuplicates(["sha256"]) if time is None else fit.withWatermark(time, delay).dropDuplicatesWithinWatermark(["sha256"])


def start(stream: DataFrame, output: str, checkpoint: str):
    return stream.writeStream.format("json").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
