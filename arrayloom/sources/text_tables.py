"""Tab-separated event lists: readers with fixed schemas, and the writer of the result list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "filename string, place int, time double, amplitude double, boss_column int, boss_row int, sensors string"
SPIKES = "skipped string, neuron string, time double, skipped2 double, sensor_col int, sensor_row int, skipped3 double"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Detected events; only the columns that a query uses are parsed. Lines that don't fit give nulls; sensors that aren't
    empty but hold a single sign, as when columns are separated by another mark, are an error."""
    events = spark.read.csv(path, sep="\t", header=True, schema=EVENTS, mode="PERMISSIVE")
    broken = F.raise_error(F.concat(F.lit("not a list of sensors: "), F.col("sensors")))
    return events.withColumn("sensors", F.when((F.length("sensors") == 1) & (F.col("sensors") != "0"), broken).otherwise(F.col("sensors")))


def read_true_spikes(spark: SparkSession, path: str) -> DataFrame:
    """Known spikes: neuron, time and sensor."""
    return spark.read.csv(path, sep="\t", header=True, schema=SPIKES).select("neuron", "time", "sensor_col", "sensor_row")


def write_result(events: DataFrame, path: str, decimals: int | None = None) -> None:
    """The result list as folder of tab-separated files with a header, at full precision unless decimals are given."""
    if decimals is not None:
        events = events.withColumns({c: F.round(c, decimals) for c, kind in events.dtypes if kind == "double"})
    events.write.csv(path, sep="\t", header=True)
