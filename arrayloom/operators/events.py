"""Detected events and the regions of interest that are built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def linear_index(row, col, rows: int):
    """Column-major index of a sensor, counting from 1."""
    return (col - 1) * rows + row


def from_linear(index, rows: int):
    """(row, col) of a column-major index."""
    return F.pmod(index - 1, F.lit(rows)) + 1, F.floor((index - 1) / rows) + 1


def valid_events(counted: DataFrame, most: int) -> DataFrame:
    """Events with at least one and at most `most` sensors, from their number (column `sensors`; see count_packed)."""
    return counted.filter((F.col("sensors") >= 1) & (F.col("sensors") <= most))


def active_sensors(events: DataFrame, row: str, col: str, least: int) -> DataFrame:
    """(row, col, n): boss sensors with at least `least` events; null sensors take no part."""
    known = events.filter(F.col(row).isNotNull() & F.col(col).isNotNull())
    return known.groupBy(row, col).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def regions(sensors: DataFrame, active: DataFrame, fill: bool = False) -> DataFrame:
    """(roi_row, roi_col, row, col): all sensors (boss_row, boss_column, sensor_row, sensor_col) that took part in events of
    an active boss sensor, and the boss itself. With `fill`, the column behind each sensor joins in (for arrays read out
    in every second one). Sensors are made distinct before the join, so a busy boss sensor is no large key of it."""
    each = sensors.select(F.col("boss_row").alias("roi_row"), F.col("boss_column").alias("roi_col"), F.col("sensor_row").alias("row"), F.col("sensor_col").alias("col")).distinct()
    took = each.join(active.select(F.col("boss_row").alias("roi_row"), F.col("boss_column").alias("roi_col")), ["roi_row", "roi_col"])
    own = active.select(F.col("boss_row").alias("roi_row"), F.col("boss_column").alias("roi_col"), F.col("boss_row").alias("row"), F.col("boss_column").alias("col"))
    every = took.unionByName(own)
    if fill:
        every = every.withColumn("col", F.explode(F.array("col", F.col("col") + 1)))
    return every.distinct()


def drop_degenerate(roi: DataFrame, by: list[str]) -> DataFrame:
    """Regions with more than one row and more than one column of sensors, with their bounding box."""
    box = roi.groupBy(*by).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"), F.count("*").alias("sensors"))
    return box.filter("r0 < r1 AND c0 < c1")


def dense_counts(events: DataFrame, row: str, col: str) -> DataFrame:
    """(row, col, n): events of every sensor of the array's box, 0 where there are none. The grid has the size of the array."""
    known = events.filter(F.col(row).isNotNull() & F.col(col).isNotNull())
    counts = known.groupBy(row, col).agg(F.count("*").alias("n"))
    box = counts.agg(*[f(c).alias(f"{f.__name__}_{i}") for i, c in enumerate((row, col)) for f in (F.min, F.max)])
    grid = box.select(F.explode(F.sequence("min_0", "max_0")).alias(row), "min_1", "max_1").select(row, F.explode(F.sequence("min_1", "max_1")).alias(col))
    return grid.join(counts, [row, col], "left").select(row, col, F.coalesce("n", F.lit(0)).alias("n"))


def region_times(events: DataFrame, active: DataFrame, time: str) -> DataFrame:
    """(boss_row, boss_column, time): the times of each region's events, each once."""
    return events.filter(F.col(time).isNotNull()).join(active.select("boss_row", "boss_column"), ["boss_row", "boss_column"]).select("boss_row", "boss_column", time).distinct()


def frame_mask(frames: DataFrame, horizon: int, total: int | None = None) -> DataFrame:
    """(frame): frames (frame) of any region, and those within `horizon` of them; a frame whose stretch would leave 1..total
    (the largest frame by default) stays single. Frames below 1 or beyond the end take no part."""
    known = frames.select(F.col("frame").cast("long").alias("frame")).filter("frame >= 1").distinct()
    last = F.lit(total) if total is not None else F.col("_last")
    if total is None:
        known = known.join(F.broadcast(known.agg(F.max("frame").alias("_last"))))  # one number
    fits = (F.col("frame") > horizon) & (F.col("frame") + horizon <= last)
    stretch = F.when(fits, F.sequence(F.col("frame") - horizon, F.col("frame") + horizon)).otherwise(F.array("frame"))
    return known.filter(F.col("frame") <= last).select(F.explode(stretch).alias("frame")).distinct()


def masked(traces: DataFrame, sensors: DataFrame | None = None, frames: DataFrame | None = None) -> DataFrame:
    """Rows of traces whose sensor (row, col) and frame are in the masks; a mask that isn't given lets all pass."""
    out = traces if sensors is None else traces.join(sensors.select("row", "col").distinct(), ["row", "col"], "left_semi")
    return out if frames is None else out.join(frames.select("frame").distinct(), "frame", "left_semi")


def expected_components(roi: DataFrame, by: list[str], pitch_row: float, pitch_col: float, neurons: float = 2029.0, each: float = 1.0) -> DataFrame:
    """(by, sensors, expected): components to look for in each region: `each` for a neuron, `neurons` a square millimetre,
    over the area of its sensors (pitches in micrometres)."""
    area = pitch_row * pitch_col / 1e6
    return roi.groupBy(*by).agg(F.count("*").alias("sensors")).withColumn("expected", F.ceil(each * neurons * area * F.col("sensors")))
