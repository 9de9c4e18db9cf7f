"""The usage log as a stream: late events, repeated deliveries, rate windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def events(spark: SparkSession, path: str, schema) -> DataFrame:
    """The events of Parquet files as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def once(stream: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """Each key once, though it may be delivered again within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def counts(stream: DataFrame, time: str, keys: list[str], width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Hits by key and window; a window is given out when the watermark has passed it."""
    return stream.withWatermark(time, late).groupBy(*keys, F.window(time, width).alias("w")).agg(F.count("*").alias("hits")).select(*keys, F.col("w.start").alias("window_start"), "hits")


def persist(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """What writes each micro-batch to a folder of its own: a batch that is delivered again after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
