"""Recordings kept as traces by tile and frame, and their metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sensor pitch in micrometres of each chip, the factor to millivolts, and the file version that is read.
PITCH = {"G1183": 7.4, "NCA": 16.0}
VERSION = "NH5_1.0.0"
TO_MILLIVOLT = {"NCA": 1000.0}


def write_traces(traces: DataFrame, path: str, tile: int = 16, chunk: int = 65_536) -> None:
    """(rec_id, row, col, frame, v) by tile of sensors and chunk of frames: a box read then opens only its folders."""
    parts = traces.withColumn("tile_row", F.floor(F.col("row") / tile)).withColumn("tile_col", F.floor(F.col("col") / tile))
    parts = parts.withColumn("frames", F.floor(F.col("frame") / chunk))
    keys = ["rec_id", "tile_row", "tile_col", "frames"]
    parts.repartition(*keys).sortWithinPartitions(*keys, "row", "col", "frame").write.partitionBy(*keys).parquet(path)


def read_box(spark: SparkSession, path: str, rec_id: str, rows: tuple[int, int], cols: tuple[int, int], frames: tuple[int, int], chip: str | None = None, tile: int = 16, chunk: int = 65_536) -> DataFrame:
    """An inclusive box of a recording; folders outside of it aren't read, and the ends are pushed down to the files."""
    t = spark.read.parquet(path).filter(F.col("rec_id") == rec_id)
    for c, part, size, (low, high) in (("row", "tile_row", tile, rows), ("col", "tile_col", tile, cols), ("frame", "frames", chunk, frames)):
        t = t.filter(F.col(part).between(low // size, high // size) & F.col(c).between(low, high))
    return t.select("rec_id", "row", "col", "frame", (F.col("v") * TO_MILLIVOLT.get(chip or "", 1.0)).alias("v"))


def sampling_rate(frames: DataFrame) -> DataFrame:
    """(rec_id, frames, sr_khz): number of frames over the span of their start times in ms."""
    return frames.groupBy("rec_id").agg(F.count("*").alias("frames"), F.try_divide(F.count("*"), F.max("t_ms") - F.min("t_ms")).alias("sr_khz"))


def recordings(frames: DataFrame, sensors: DataFrame, chips: DataFrame) -> DataFrame:
    """(rec_id, frames, sr_khz, rows, cols, chip, pitch): facts of each recording from its frames (rec_id, t_ms), its sensors
    (rec_id, row, col; the ids that were read out, ascending) and its chip (rec_id, chip, version). Another file version or
    an unknown chip is an error."""
    ids = sensors.groupBy("rec_id").agg(*[F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in ("row", "col")])  # the array's sides
    pitch = F.coalesce(*[F.when(F.col("chip") == chip, F.lit(p)) for chip, p in PITCH.items()])
    pitch = F.when(F.col("version") != VERSION, F.raise_error(F.concat(F.lit("unknown file version "), "version")).cast("double")).otherwise(pitch)
    pitch = F.coalesce(pitch, F.raise_error(F.concat(F.lit("unknown chip "), F.coalesce("chip", F.lit("?")))).cast("double"))
    return sampling_rate(frames).join(ids, "rec_id").join(chips.select("rec_id", "chip", pitch.alias("pitch")), "rec_id")
