"""Time buckets over a stream, with a watermark for late rows; the same function serves tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bucketed(events: DataFrame, time: str, size: str, keys: list[str], value: str, late: str | None = None) -> DataFrame:
    """Count and sum of each bucket of ``size`` and key; with ``late``, rows later than that are left out."""
    df = events.withColumn(time, F.col(time).cast("timestamp"))
    if late:
        df = df.withWatermark(time, late)
    out = df.groupBy(F.window(time, size).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), *keys, "n", "total")


def stream_parquet(spark: SparkSession, path: str, schema: T.StructType, files_a_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder, bounded a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """All that's there now, exactly once, then stop."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
