"""Running counts over a stream of detected events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayloom.session import scratch_path


def once(stream: DataFrame, key: str, arrived: str, late: str) -> DataFrame:
    """Records of a stream without repeats of a key that arrive within `late`; state older than that is dropped."""
    return stream.withWatermark(arrived, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, by: list[str], arrived: str, width: str) -> DataFrame:
    """Events per window of arrival and key columns."""
    return stream.groupBy(F.window(arrived, width).alias("w"), *by).agg(F.count("*").alias("n"))


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process what is there, exactly once into a Parquet table of the shared folder, and read that table."""
    spark: SparkSession = stream.sparkSession
    path = scratch_path(spark)
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
