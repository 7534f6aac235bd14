"""Sorted units: templates, quality, coincidence and redundancy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arrayloom.operators.components import connected_components
from arrayloom.operators.joins import band_pairs, pairs_within
from arrayloom.session import write_through


def boss_sensors(templates: DataFrame) -> DataFrame:
    """(unit_id, boss_row, boss_col, lag, extremum): the sensor and lag of largest |v|; ties to the first in
    column-major order, then the first lag. Null values take no part."""
    size = F.struct(F.abs("v").alias("s"), -F.col("sensor_col"), -F.col("sensor_row"), -F.col("lag"))
    best = F.max_by(F.struct("sensor_row", "sensor_col", "lag", "v"), size)
    known = templates.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    return known.groupBy("unit_id").agg(best.alias("b")).select(
        "unit_id", F.col("b.sensor_row").alias("boss_row"), F.col("b.sensor_col").alias("boss_col"), "b.lag", F.col("b.v").alias("extremum")
    )


def amplitude_quality(spikes: DataFrame, noise: DataFrame) -> DataFrame:
    """Per unit: n, mean |amplitude|, its standard deviation (0 for one spike), their ratio, and the distance from
    the noise. Repeated spikes count once."""
    once = spikes.select("spike_id", "unit_id", "amplitude").filter("amplitude IS NOT NULL AND NOT isnan(amplitude)").distinct()
    stats = once.groupBy("unit_id").agg(
        F.count("*").alias("n"), F.avg(F.abs("amplitude")).alias("mean_amp"),
        F.coalesce(F.stddev_samp("amplitude"), F.lit(0.0)).alias("amplitude_sd"), F.min("amplitude").alias("least"), F.max("amplitude").alias("greatest"),
    )
    out = stats.join(noise, "unit_id")
    return out.withColumn("rstd", F.try_divide("amplitude_sd", "mean_amp")).withColumn("separability", F.try_divide("mean_amp", "noise_std"))


def select_by_range(units: DataFrame, feature: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Units whose feature lies in a range. NaN lies in every range, null in none."""
    x = F.col(feature)
    inside = (F.lit(True) if low is None else x >= low) & (F.lit(True) if high is None else x <= high)
    return units.filter(F.isnan(x) | (x.isNotNull() & inside))


def template_similarity(templates: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, cosine) of pairs of units: cosine of their templates after the lags of their extrema are put together,
    over the lags and sensors that both have."""
    known = templates.filter(F.col("v").isNotNull() & ~F.isnan("v")).select("unit_id", "sensor_row", "sensor_col", "lag", "v").distinct()
    peak = boss_sensors(known).select("unit_id", F.col("lag").alias("_peak"))
    shifted = known.join(peak, "unit_id").withColumn("lag", F.col("lag") - F.col("_peak")).drop("_peak")
    a = pairs.select("a", "b").distinct().join(shifted.withColumnRenamed("unit_id", "a").withColumnRenamed("v", "x"), "a")
    both = a.join(shifted.withColumnRenamed("unit_id", "b").withColumnRenamed("v", "y"), ["b", "sensor_row", "sensor_col", "lag"])
    dot, xx, yy = (F.sum(F.col(p) * F.col(q)) for p, q in (("x", "y"), ("x", "x"), ("y", "y")))
    return both.groupBy("a", "b").agg(F.try_divide(dot, F.sqrt(xx * yy)).alias("cosine"))


def best_lag(spikes: DataFrame, pairs: DataFrame, bin_ms: float, most: int) -> DataFrame:
    """(a, b, lag, n): of each pair of units the shift of b, in bins within +-most, at which most spikes fall into
    common bins (products of counts); ties to the smaller lag. Pairs that never meet give no row."""
    counts = spikes.filter("time IS NOT NULL AND NOT isnan(time)").select("spike_id", "unit_id", F.floor(F.col("time") / bin_ms).alias("bin")).distinct()
    counts = counts.groupBy("unit_id", "bin").agg(F.count("*").alias("n"))
    left = pairs.select("a", "b").distinct().join(counts.select(F.col("unit_id").alias("a"), F.col("bin"), F.col("n").alias("na")), "a")
    right = counts.select(F.col("unit_id").alias("b"), F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag"), "bin", F.col("n").alias("nb"))
    met = left.join(right.withColumn("bin", F.col("bin") + F.col("lag")), ["b", "bin"])
    sums = met.groupBy("a", "b", "lag").agg(F.sum(F.col("na") * F.col("nb")).alias("n"))
    top = F.max(F.struct("n", (-F.col("lag")).alias("l")))
    return sums.groupBy("a", "b").agg(top.alias("t")).select("a", "b", (-F.col("t.l")).alias("lag"), F.col("t.n").alias("n"))


def coincidence_fractions(spikes: DataFrame, pairs: DataFrame, jitter: float) -> DataFrame:
    """(a, b, n, frac_a, frac_b): spikes of a with exactly one spike of b within `jitter`, and their share of both. If the
    pairs have a column `shift`, b's spikes are moved by it first (see best_lag); null is none."""
    once = spikes.filter("time IS NOT NULL AND NOT isnan(time)").select("spike_id", "unit_id", "time").distinct()
    size = once.groupBy("unit_id").agg(F.count("*").alias("n"))
    shifted = "shift" in pairs.columns
    wanted = pairs.select("a", "b", *([F.coalesce("shift", F.lit(0.0)).alias("shift")] if shifted else [])).distinct()
    left = wanted.select("a", "b").join(once.select(F.col("unit_id").alias("a"), F.col("spike_id").alias("sa"), F.col("time").alias("ta")), "a")
    left = left.withColumn("bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda o: F.floor(F.col("ta") / jitter) + o)))
    right = once.select(F.col("unit_id").alias("b"), F.col("time").alias("tb"))
    if shifted:
        right = wanted.join(right, "b").select("a", "b", (F.col("tb") + F.col("shift")).alias("tb"))
    right = right.withColumn("bucket", F.floor(F.col("tb") / jitter))
    near = left.join(right, ["a", "b", "bucket"] if shifted else ["b", "bucket"]).filter(F.abs(F.col("ta") - F.col("tb")) <= jitter)
    one = near.groupBy("a", "b", "sa").agg(F.count("*").alias("k")).filter("k = 1").groupBy("a", "b").agg(F.count("*").alias("n"))
    sized = one.join(size.select(F.col("unit_id").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("unit_id").alias("b"), F.col("n").alias("nb")), "b")
    return sized.select("a", "b", "n", (F.col("n") / F.col("na")).alias("frac_a"), (F.col("n") / F.col("nb")).alias("frac_b"))


def shifted_coincidences(spikes: DataFrame, pairs: DataFrame, bin_ms: float, most: int, jitter: float) -> DataFrame:
    """(a, b, lag, n, frac_a, frac_b): coincidence_fractions after each b is moved by the lag at which most of its spikes
    meet those of a (0 where none do)."""
    lags = write_through(pairs.select("a", "b").distinct().join(best_lag(spikes, pairs, bin_ms, most).select("a", "b", "lag"), ["a", "b"], "left").fillna(0, ["lag"]))
    found = coincidence_fractions(spikes, lags.withColumn("shift", F.col("lag") * bin_ms), jitter)
    return found.join(lags, ["a", "b"]).select("a", "b", "lag", "n", "frac_a", "frac_b")


def _blocks(units: DataFrame, row: str, col: str, distance: float) -> DataFrame:
    """(unit_id, block): units linked by steps of at most `distance`, with the smallest unit of their block. Steps lead
    from place to place, so units of one place are linked to its first one only."""
    places = units.select("unit_id", row, col).distinct()
    known = places.filter(f"{row} - {row} = 0 AND {col} - {col} = 0")  # neither null, NaN nor infinite
    firsts = known.groupBy(row, col).agg(F.min("unit_id").alias("_first"))
    own = known.join(firsts, [row, col]).select(F.col("unit_id").alias("a"), F.col("_first").alias("b"))
    steps = pairs_within(firsts, "_first", row, col, distance).select("a", "b").unionByName(own)
    return connected_components(steps, "a", "b", places, "unit_id").withColumnRenamed("component", "block")


def _often_near(spikes: DataFrame, templates: DataFrame, width: float, least: float, side: int = 4) -> DataFrame:
    """(a, b), a < b: pairs of units with a sensor in common that may share at least `least` of both their spikes, as so
    many of their pairs of spikes lie within `width`. Spikes meet in tiles of side * side sensors and buckets of time; units
    that share several tiles are counted in each, so no pair is lost, and few others are kept."""
    tiles = templates.select("unit_id", *[F.floor(F.col(f"sensor_{c}") / side).alias(f"_{c}") for c in ("row", "col")]).distinct()
    sized = spikes.select("unit_id", "time").withColumn("n", F.count("*").over(Window.partitionBy("unit_id")))
    mine = sized.join(tiles, "unit_id")
    a, b = (mine.select("_row", "_col", F.col("unit_id").alias(s), F.col("n").alias(f"n{s}"), F.col("time").alias(f"t{s}")) for s in "ab")
    near = band_pairs(a, b, ["_row", "_col"], "ta", "tb", width, 8).filter("a < b")
    met = near.groupBy("a", "b").agg(F.count("*").alias("met"), F.first(F.greatest("na", "nb")).alias("n"))
    return met.filter(F.col("met") / F.col("n") >= least).select("a", "b")


def redundancy_groups(units: DataFrame, spikes: DataFrame, templates: DataFrame, row: str, col: str, distance: float, bin_ms: float, most: int, jitter: float, least_coincidence: float, least_similarity: float) -> DataFrame:
    """(unit_id, block, component): units that are the same neuron. Blocks are units linked by steps of at most `distance`;
    inside a block two units are one if both share at least `least_coincidence` of their spikes after the best shift
    (see shifted_coincidences), and their templates are alike. Templates without a common sensor aren't, so only pairs are
    compared that have one, and enough spikes near each other within the largest shift and the jitter (see _often_near);
    the spikes and templates of other units are left aside. Runs jobs while it is called."""
    blocks = write_through(_blocks(units, row, col, distance))
    once = spikes.filter("time IS NOT NULL AND NOT isnan(time)").select("spike_id", "unit_id", "time").distinct()
    known = templates.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    often = _often_near(once, known, (most + 1) * bin_ms + jitter, least_coincidence)
    a, b = (blocks.select(F.col("unit_id").alias(s), "block") for s in "ab")
    pairs = write_through(often.join(a, "a").join(b, ["b", "block"]).select("a", "b"))
    few = pairs.select(F.explode(F.array("a", "b")).alias("unit_id")).distinct()
    mine, theirs = (write_through(df.join(few, "unit_id", "left_semi")) for df in (once, known))
    shared = shifted_coincidences(mine, pairs, bin_ms, most, jitter).filter((F.col("frac_a") >= least_coincidence) & (F.col("frac_b") >= least_coincidence))
    alike = template_similarity(theirs, shared).filter(F.col("cosine") >= least_similarity)
    return connected_components(alike, "a", "b", blocks, "unit_id").join(blocks, "unit_id").select("unit_id", "block", "component")


def rethreshold(peaks: DataFrame, thresholds: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, mean_amp, amplitude_sd, rstd, separability) of units whose threshold has been moved: spikes are the peaks
    (by, amplitude) at or below `threshold` (by, threshold, noise_std); separability is the distance of their mean
    |amplitude| from that of the other peaks, from 0 where there are none, over the noise. Units without a spike left give
    no row; null and NaN amplitudes take no part."""
    known = peaks.filter("amplitude IS NOT NULL AND NOT isnan(amplitude)").join(thresholds.select(*by, "threshold", "noise_std"), by)
    valid = F.col("amplitude") <= F.col("threshold")
    mine, size = F.when(valid, F.col("amplitude")), F.abs("amplitude")
    out = known.groupBy(*by).agg(
        F.count(mine).alias("n"), F.avg(F.abs(mine)).alias("mean_amp"), F.coalesce(F.stddev_samp(mine), F.lit(0.0)).alias("amplitude_sd"),
        F.coalesce(F.avg(F.when(~valid, size)), F.lit(0.0)).alias("_other"), F.first("noise_std").alias("_noise"),
    ).filter("n > 0")
    out = out.withColumn("rstd", F.try_divide("amplitude_sd", "mean_amp")).withColumn("separability", F.try_divide(F.col("mean_amp") - F.col("_other"), F.col("_noise")))
    return out.drop("_other", "_noise")


def backfill(units: DataFrame, computed: DataFrame, by: list[str], features: list[str]) -> DataFrame:
    """Units with null or NaN features taken from `computed` (by and the same names); what that lacks stays missing."""
    new = computed.select(*by, *[F.col(c).alias(f"_{c}") for c in features])
    filled = {c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.col(f"_{c}"), F.col(c)) for c in features}
    return units.join(new, by, "left").withColumns(filled).select(*units.columns)


def ordered_units(units: DataFrame, by: list[str], feature: str, descending: bool = True, key: str = "unit_id") -> DataFrame:
    """Adds rank in each group by a feature; NaN ranks as the largest number, nulls come last, ties in order of the key."""
    order = F.desc_nulls_last(feature) if descending else F.asc_nulls_last(feature)
    return units.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(order, key)))


def keep_best(units: DataFrame, group: str, score: str) -> DataFrame:
    """Adds keep: whether a unit's score equals the best of its group; ties all stay, null and NaN lose to numbers."""
    known = F.when(~F.isnan(score), F.col(score))
    best = units.groupBy(group).agg(F.max(known).alias("_best"), F.count("*").alias("_size"))
    keep = (F.col("_size") == 1) | F.coalesce(known == F.col("_best"), F.lit(False))
    return units.join(best, group).withColumn("keep", keep).drop("_best", "_size")


def first_places(spikes: DataFrame, label: str, key: str) -> DataFrame:
    """(label, sensor_row, sensor_col, n): per label the position of its first record and the number of records.
    Labels are compared without surrounding white space and case; repeated records count once."""
    first = F.min_by(F.struct("sensor_row", "sensor_col"), key)
    name = F.lower(F.regexp_replace(label, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).alias(label)
    once = spikes.filter(F.col(label).isNotNull()).select(key, name, "sensor_row", "sensor_col").distinct()
    return once.groupBy(label).agg(first.alias("p"), F.count("*").alias("n")).select(label, "p.*", "n")


def numbered(units: DataFrame, order: list[str], name: str = "running_id") -> DataFrame:
    """Adds a running number in the given order without bringing the rows into one task: ranges are ordered
    side by side, and each starts where the ranges before it end."""
    from arrayloom.session import reliable_checkpoint

    ranged = reliable_checkpoint(units.repartitionByRange(*order).sortWithinPartitions(*order))
    at = ranged.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    sizes = at.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    start = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_p", "_first", start.alias("_start"))  # one row for each task
    return at.join(F.broadcast(starts), "_p").withColumn(name, F.col("_m") - F.col("_first") + F.col("_start") + 1).drop("_p", "_m", "_first", "_start")


def lag_product(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """(by, lag, v): Cauchy product over the lags of two tensors (by, sensor_row, sensor_col, lag, v), summed over sensors."""
    other = right.select(*by, "sensor_row", "sensor_col", F.col("lag").alias("_lag"), F.col("v").alias("_v"))
    both = left.join(other, [*by, "sensor_row", "sensor_col"])
    return both.groupBy(*by, (F.col("lag") + F.col("_lag")).alias("lag")).agg(F.sum(F.col("v") * F.col("_v")).alias("v"))


def numbered_within(df: DataFrame, by: list[str], order: list[str], name: str = "frame") -> DataFrame:
    """Adds a running number within each group in the given order, however large a group is: ranges of (by, order) are
    sorted side by side, and each counts on from where its first group stood at the end of the ranges before. Ties of the
    order are numbered in any way. Runs a job while it is called."""
    from arrayloom.session import reliable_checkpoint

    ranged = reliable_checkpoint(df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order))
    at = ranged.withColumn("_p", F.spark_partition_id())
    ahead = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = at.groupBy(*by, "_p").agg(F.count("*").alias("_n")).withColumn("_start", F.sum("_n").over(ahead))
    starts = sizes.filter("_start > 0").select("_p", "_start")  # at most one row for each task
    names, fields = df.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            codes = [pa.compute.dictionary_encode(batch.column(c), null_encoding="encode").indices.to_numpy() for c in by]
            first = np.append(True, np.any([np.diff(c) != 0 for c in codes], axis=0))
            places = np.arange(batch.num_rows)
            numbers = places - np.maximum.accumulate(np.where(first, places, 0)) + 1
            key = [batch.column(c)[0].as_py() for c in by]
            run = np.cumsum(first) == 1
            if n is None:
                numbers[run] += batch.column("_start")[0].as_py() or 0
            elif key == last:
                numbers[run] += n
            last, n = [batch.column(c)[-1].as_py() for c in by], int(numbers[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(numbers)], names=[*names, name])

    return at.join(F.broadcast(starts), "_p", "left").select(*df.columns, "_start").mapInArrow(count, f"{fields}, `{name}` bigint")
