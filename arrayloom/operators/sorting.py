"""From the traces of regions of interest to sorted units.

The way: stack lags, find the number of sources in the spectrum, separate them, turn them so that peaks point down, tell
noise from units, find spikes, group their amplitudes, take the winning group, measure it, drop mixtures, average the
raw traces around the spikes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arrayloom.functions import signal as S
from arrayloom.operators import decompose as D
from arrayloom.operators import density as N
from arrayloom.operators.order import order_estimates
from arrayloom.session import write_through

BY = ["roi_id", "comp"]


@dataclass
class Separation:
    """Sources (roi_id, comp, frame, v), the weights (roi_id, comp, channel, lag, weight) with which they stand in the
    channels, and whether each region's separation has settled (roi_id, converged)."""

    sources: DataFrame
    filters: DataFrame
    settled: DataFrame


def _separate(stacked: DataFrame, components: int | None) -> Separation:
    """FastICA of frames (roi_id, channel, lag, frame, v): of `components` sources, or as many as the line through the
    spectrum of each region tells (see order_estimates)."""
    stacked = write_through(stacked.withColumn("at", F.struct("channel", "lag")))
    frames = write_through(D.frames_of(stacked, ["roi_id"], "at", fill=0.0))
    axes = write_through(D.principal_axes(frames, ["roi_id"]))
    if components is None:
        few = order_estimates(axes, ["roi_id"], "variance", 1.0).select("roi_id", F.coalesce("by_line", "n").alias("components"))
        number: int | DataFrame = write_through(few)
    else:
        number = components
    sources, model = D.fast_ica(frames, ["roi_id"], number, axes=axes)
    names = stacked.select("roi_id", "channel", "lag").distinct()
    place = F.row_number().over(Window.partitionBy("roi_id").orderBy("channel", "lag")) - 1  # over the channels of a region
    filters = D.mixing(axes, model, ["roi_id"], number).join(names.withColumn("at", place), ["roi_id", "at"]).drop("at")
    each = write_through(sources.select("roi_id", "frame", F.posexplode("x").alias("comp", "v")).select(*BY, "frame", "v"))
    return Separation(each, filters, model.select("roi_id", "converged"))


def embedded(traces: DataFrame, components: int | None = None, lags: int = 7) -> Separation:
    """The channels of each region stacked with their next lags. traces: roi_id, channel, frame, v; a frame that a channel
    lacks reads 0."""
    return _separate(S.lag_embed(traces, ["roi_id", "channel"], lags), components)


def instantaneous(traces: DataFrame, components: int | None = None) -> Separation:
    """The same without lags."""
    return _separate(traces.withColumn("lag", F.lit(0)), components)


#: Exchangeable separation steps: functions of traces and the number of components.
SORTERS: dict[str, Callable[..., Separation]] = {"embedded": embedded, "instantaneous": instantaneous}


def find_spikes(sources: DataFrame, times_sigma: float = 3.0, least_skew: float = 0.2, least_peaks: float = 10, most_rstd: float = 0.5, half_window: int = 5) -> tuple[DataFrame, DataFrame]:
    """(units, spikes). Each source gets a unit with a status: `noise` if its skewness or its number of peaks is too small,
    `mixture` if the relative spread of its winning group of amplitudes is too large, else `kept`. Spikes are those of the
    winning groups of mixtures and kept ones whose window lies in the trace: groups of amplitudes are ranked by the length
    of their mean waveform, and a tight winner takes the second one in (see density.roles)."""
    turned = write_through(S.sign_correct(sources, BY))
    peaks = write_through(S.peaks(turned, BY, times_sigma))
    counts = peaks.groupBy(*BY).agg(F.count("*").alias("peaks"))
    shape = S.moments(turned, BY).join(counts, BY, "left").fillna(0, ["peaks"])
    loud = (F.abs("skewn") > least_skew) & (F.col("peaks") >= least_peaks)
    shape = write_through(shape.withColumn("loud", F.coalesce(loud, F.lit(False))))
    windows = write_through(S.snippets(turned, peaks.join(shape.filter("loud"), BY, "left_semi"), BY, half_window, half_window))
    found = windows.filter("lag = 0").select(*BY, "spike", F.col("v").alias("amplitude"))
    assigned = write_through(N.assign(found, N.mixtures(found, BY, "amplitude"), BY, "amplitude", "spike").withColumnRenamed("component", "level"))
    by_level = windows.join(assigned.select(*BY, "spike", "level"), [*BY, "spike"])
    scores = S.waveform_spread(by_level, [*BY, "level"]).select(*BY, F.col("level").alias("component"), F.col("norm").alias("score"))
    leveled = assigned.withColumnRenamed("level", "component").withColumnRenamed("comp", "source")
    scores = scores.withColumnRenamed("comp", "source")
    by = ["roi_id", "source"]
    noise = peaks.groupBy(*BY).agg(F.first("sigma").alias("noise_std")).withColumnRenamed("comp", "source")
    roles = write_through(N.roles(leveled, by, "amplitude", scores))
    quality = N.winners(leveled, by, "amplitude", noise, scores).join(noise, by)
    quality = quality.join(N.winner_isolation(leveled, by, "amplitude", scores), by, "left").withColumnRenamed("source", "comp")
    spikes = leveled.join(roles.filter("role = 'winner'"), [*by, "component"], "left_semi").select("roi_id", F.col("source").alias("comp"), F.col("spike").alias("frame"), "amplitude")
    spikes = write_through(spikes)
    spread = S.waveform_spread(windows.join(spikes.select(*BY, F.col("frame").alias("spike")), [*BY, "spike"]), BY).select(*BY, "sd_score")
    units = shape.join(quality, BY, "left").join(spread, BY, "left")
    status = F.when(~F.col("loud") | F.col("n").isNull(), "noise").when(F.col("rstd").isNull() | F.isnan("rstd") | (F.col("rstd") > most_rstd), "mixture").otherwise("kept")
    return write_through(units.withColumn("status", status).drop("loud")), spikes


def positions(units: DataFrame, spikes: DataFrame, traces: DataFrame, half_window: int = 5) -> tuple[DataFrame, DataFrame]:
    """(units, templates): the mean trace of every channel of a unit's region around its spikes, and units with their boss
    channel (that of the largest |mean|, ties to the smaller), its extremum and its signal-to-noise ratio there."""
    ends = traces.groupBy("roi_id").agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    whole = spikes.join(ends, "roi_id").filter((F.col("frame") - half_window >= F.col("a")) & (F.col("frame") + half_window <= F.col("b")))
    lags = F.explode(F.sequence(F.lit(-half_window), F.lit(half_window))).alias("lag")
    wanted = whole.select(*BY, lags, F.col("frame").alias("spike")).select(*BY, "lag", (F.col("spike") + F.col("lag")).alias("frame"))
    mean = write_through(wanted.join(traces, ["roi_id", "frame"]).groupBy(*BY, "channel", "lag").agg(F.avg("v").alias("v")))
    boss = mean.groupBy(*BY).agg(F.max(F.struct(F.abs("v").alias("s"), (-F.col("channel")).alias("c"), "v")).alias("t"))
    boss = boss.select(*BY, (-F.col("t.c")).alias("boss_channel"), F.col("t.v").alias("extremum"))
    sigma = S.noise_sigma(traces, ["roi_id", "channel"]).withColumnRenamed("channel", "boss_channel")
    boss = boss.join(sigma, ["roi_id", "boss_channel"], "left").withColumn("snr", F.try_divide(F.abs("extremum"), F.col("sigma"))).drop("sigma")
    return units.join(boss, BY, "left"), mean


def sort_regions(traces: DataFrame, components: int | None = None, sorter: str = "embedded", half_window: int = 5, **thresholds: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(units, spikes, templates, filters) of every region: units as of find_spikes and positions, with `converged`, which
    tells whether their region's separation has settled. Units that two regions have found are left to
    units.redundancy_groups. Runs jobs while it is called."""
    parts = SORTERS[sorter](traces, components)
    units, spikes = find_spikes(parts.sources, half_window=half_window, **thresholds)
    units, templates = positions(units, spikes, traces, half_window)
    return units.join(parts.settled, "roi_id"), spikes, templates, parts.filters
