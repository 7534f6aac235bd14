"""Operators on traces in long form: (channel columns, frame, v), frames counting up without gaps.

Operators that look at neighbouring frames work on chunks of frames with a halo, so a channel of any
length is spread over tasks.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrayloom.session import write_through

CHUNK = 65_536
#: Fixed value: median of |x| over the standard deviation, for normally distributed x.
MEDIAN_OVER_SIGMA = 0.6745


def with_halo(df: DataFrame, frame: str, before: int, after: int, chunk: int = CHUNK) -> DataFrame:
    """Adds `chunk` and `core`: each row once as core of its chunk, and as halo of the neighbours that look
    `before` frames back or `after` frames ahead."""
    low, high = F.floor((F.col(frame) - after) / chunk), F.floor((F.col(frame) + before) / chunk)
    return df.withColumn("chunk", F.explode(F.sequence(low, high))).withColumn("core", F.floor(F.col(frame) / chunk) == F.col("chunk"))


def _line(by: list[str]) -> Window:
    return Window.partitionBy(*by, "chunk").orderBy("frame")


def _core(df: DataFrame) -> DataFrame:
    return df.filter("core").drop("chunk", "core")


def medians(df: DataFrame, by: list[str], value: Column, most: int = 1_000_000) -> DataFrame:
    """(by, median): the exact median of each group. Groups of more than `most` values are narrowed down first: each pass
    counts the values between two ends in 1024 cells and goes on with the cell that holds the middle, until it has at most
    `most` values, all are equal, or the two middle ones lie in different cells. Null and NaN take no part. Runs a job
    while it is called, and one more for each pass."""
    x = df.select(*by, value.cast("double").alias("x")).filter("x IS NOT NULL AND NOT isnan(x)")
    sizes = x.groupBy(*by).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    sizes = write_through(sizes.withColumns({"below": F.lit(0).cast("long"), "inside": F.col("n")}))
    wide = (F.col("inside") > most) & (F.col("lo") < F.col("hi"))
    large = sizes.filter(wide)
    if large.isEmpty():
        return x.groupBy(*by).agg(F.median("x").alias("median"))
    few, solved, columns = sizes.filter(~wide), [], [*by, "n", "lo", "hi", "below", "inside"]
    while not large.isEmpty():
        near = x.join(large, by).filter(F.col("x").between(F.col("lo"), F.col("hi")))
        # cells of equal width on a scale of magnitudes; on a plain one, where the ends are too near for that
        g = {c: F.signum(c) * F.ln(1 + F.least(F.abs(c), F.lit(1e240)) * 2.0**200) for c in ("x", "lo", "hi")}
        share = F.when(g["hi"] - g["lo"] > 1e-9, (g["x"] - g["lo"]) / (g["hi"] - g["lo"])).otherwise(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")))
        cell = F.least(F.floor(share * 1024), F.lit(1023))
        cells = near.groupBy(*by, "n", "below", "inside", cell.alias("cell")).agg(F.count("*").alias("c"), F.min("x").alias("a"), F.max("x").alias("b"))
        ahead = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # over at most 1024 cells
        cells = cells.withColumn("before", F.col("below") + F.coalesce(F.sum("c").over(ahead), F.lit(0)))
        holds = [(F.col("before") <= k) & (k < F.col("before") + F.col("c")) for k in (F.expr("(n - 1) div 2"), F.expr("n div 2"))]
        halves = cells.groupBy(*by, "n", F.col("inside").alias("was")).agg(*[F.max(F.when(h, F.struct("cell", "a", "b", "before", "c"))).alias(f"h{i}") for i, h in enumerate(holds)])
        halves = write_through(halves)
        apart = F.col("h0.cell") != F.col("h1.cell")
        solved.append(halves.filter(apart).select(*by, ((F.col("h0.b") + F.col("h1.a")) / 2).alias("median")))
        inner = halves.filter(~apart).select(*by, "n", F.col("h0.a").alias("lo"), F.col("h0.b").alias("hi"), F.col("h0.before").alias("below"), F.col("h0.c").alias("inside"), "was")
        more = wide & (F.col("inside") < F.col("was"))  # values beyond 1e240 may not part
        few, large = few.unionByName(inner.filter(~more).select(*columns)), inner.filter(more).select(*columns)
    equal = few.filter("lo = hi").select(*by, F.col("lo").alias("median"))
    rest = x.join(few.filter("lo < hi"), by).filter(F.col("x").between(F.col("lo"), F.col("hi")))
    listed = rest.groupBy(*by, "n", "below").agg(F.array_sort(F.collect_list("x")).alias("l"))  # at most `most` values
    middle = [F.get("l", (k - F.col("below")).cast("int")) for k in (F.expr("(n - 1) div 2"), F.expr("n div 2"))]
    return reduce(DataFrame.unionByName, [equal, listed.select(*by, ((middle[0] + middle[1]) / 2).alias("median")), *solved])


def noise_sigma(df: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    """Robust noise level of each channel: median(|v|) / 0.6745, not centred. Null and NaN take no part."""
    return medians(df, by, F.abs(value)).select(*by, (F.col("median") / MEDIAN_OVER_SIGMA).alias("sigma"))


def center_scale(df: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    """Adds z: v less the channel's mean, over the robust sigma of the centred trace; null where that is 0."""
    mean = df.groupBy(*by).agg(F.avg(value).alias("_mean"))
    centred = df.join(mean, by).withColumn("z", F.col(value) - F.col("_mean")).drop("_mean")
    sigma = noise_sigma(centred, by, "z")
    return centred.join(sigma, by).withColumn("z", F.try_divide("z", "sigma")).drop("sigma")


def moments(df: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    """Biased skewness and non-excess kurtosis (3 for a normal distribution) of each channel."""
    return df.groupBy(*by).agg(F.skewness(value).alias("skewn"), (F.kurtosis(value) + 3).alias("kurt"))


def sign_correct(df: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    """Turn channels of positive skewness over, so that their peaks point down."""
    skew = df.groupBy(*by).agg(F.skewness(value).alias("_skew"))
    return df.join(skew, by).withColumn(value, F.when(F.col("_skew") > 0, -F.col(value)).otherwise(F.col(value))).drop("_skew")


def peaks(df: DataFrame, by: list[str], times_sigma: float, value: str = "v", chunk: int = CHUNK) -> DataFrame:
    """Negative peaks: (by, frame, v, sigma) where -v exceeds times_sigma * sigma, the frame before, and is no
    less than the frame behind (of a plateau the first). Ends are no peaks. Channels without noise have none."""
    sigma = noise_sigma(df, by, value)
    line = _line(by)
    near = with_halo(df.select(*by, "frame", F.col(value).alias("v")), "frame", 1, 1, chunk)
    near = near.withColumn("_before", F.lag("v").over(line)).withColumn("_behind", F.lead("v").over(line))
    top = _core(near).filter((-F.col("v") > -F.col("_before")) & (-F.col("v") >= -F.col("_behind")) & ~F.isnan("v"))
    return top.join(sigma, by).filter(-F.col("v") > times_sigma * F.col("sigma")).select(*by, "frame", "v", "sigma")


def onset_peaks(df: DataFrame, by: list[str], threshold: Column, ahead: int, value: str = "v", chunk: int = CHUNK) -> DataFrame:
    """Upward crossings of a threshold and the largest value (the first of equals) from the frame before the
    crossing to `ahead` frames on: (by, onset, frame, peak). Beyond the end the trace counts as 0."""
    line = _line(by)
    near = with_halo(df.select(*by, "frame", F.col(value).alias("v")), "frame", 1, ahead, chunk)
    last = F.max("frame").over(Window.partitionBy(*by, "chunk"))
    above = (F.col("v") > threshold).cast("int")
    near = near.withColumn("_above", above).withColumn("_next", F.lead("_above").over(line)).withColumn("_last", last)
    best = F.max(F.struct(F.col("v"), (-F.col("frame")).alias("f"))).over(line.rowsBetween(0, ahead))
    found = _core(near.withColumn("_best", best)).filter("_above = 0 AND _next = 1")
    return found.select(*by, F.col("frame").alias("onset"), (-F.col("_best.f")).alias("frame"), F.col("_best.v").alias("peak"))


def dilate(df: DataFrame, by: list[str], seed: str, horizon: int, total: str, chunk: int = CHUNK) -> DataFrame:
    """Adds mask: frames within `horizon` of a seed; a seed whose stretch would leave 1..total stays single.
    `total` is the column with the number of frames of the channel."""
    fits = F.col(seed) & (F.col("frame") > horizon) & (F.col("frame") + horizon <= F.col(total))
    near = with_halo(df.withColumn("_fits", fits.cast("int")), "frame", horizon, horizon, chunk)
    spread = F.max("_fits").over(_line(by).rowsBetween(-horizon, horizon)) == 1
    return _core(near.withColumn("mask", spread | F.col(seed))).drop("_fits")


def lag_embed(df: DataFrame, by: list[str], lags: int, value: str = "v", chunk: int = CHUNK) -> DataFrame:
    """Long form of stacked forward lags: (by, frame, lag, v), every frame with each lag 0..lags-1; the last `lags`
    frames read 0."""
    last = df.groupBy(*by).agg(F.max("frame").alias("_last"))
    near = with_halo(df.select(*by, "frame", F.col(value).alias("v")), "frame", 0, lags - 1, chunk)
    stacked = near.withColumn("_ahead", F.collect_list("v").over(_line(by).rowsBetween(0, lags - 1)))
    rows = _core(stacked).join(last, by)
    zeros = F.array_repeat(F.lit(0.0), lags)
    whole = F.when(F.col("frame") > F.col("_last") - lags, zeros).otherwise(F.col("_ahead"))
    return rows.select(*by, "frame", F.posexplode(whole).alias("lag", "v"))


def snippets(df: DataFrame, spikes: DataFrame, by: list[str], before: int, behind: int, value: str = "v") -> DataFrame:
    """(by, spike, lag, v): the trace around each spike frame; spikes whose window leaves the trace are dropped."""
    ends = df.groupBy(*by).agg(F.min("frame").alias("_a"), F.max("frame").alias("_b"))
    whole = spikes.select(*by, F.col("frame").alias("spike")).join(ends, by)
    whole = whole.filter((F.col("spike") - before >= F.col("_a")) & (F.col("spike") + behind <= F.col("_b")))
    lags = F.explode(F.sequence(F.lit(-before), F.lit(behind))).alias("lag")
    wanted = whole.select(*by, "spike", lags).withColumn("frame", F.col("spike") + F.col("lag"))
    return wanted.join(df.select(*by, "frame", F.col(value).alias("v")), [*by, "frame"]).select(*by, "spike", "lag", "v")


def template(windows: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """(by, lag, v): mean of snippets, weighted if a weight column is given."""
    if weight is None:
        return windows.groupBy(*by, "lag").agg(F.avg("v").alias("v"))
    return windows.groupBy(*by, "lag").agg(F.try_divide(F.sum(weight * F.col("v")), F.sum(weight)).alias("v"))


def waveform_spread(windows: DataFrame, by: list[str]) -> DataFrame:
    """(by, sd_score, norm): the largest standard deviation over the lags, and the length of the mean waveform."""
    lags = windows.groupBy(*by, "lag").agg(F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("s"), F.avg("v").alias("m"))
    return lags.groupBy(*by).agg(F.max("s").alias("sd_score"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))


def fir(df: DataFrame, by: list[str], weights: list[float], value: str = "v", chunk: int = CHUNK) -> DataFrame:
    """Adds y: the causal filter sum(weights[k] * v[frame - k]); before the start the trace counts as 0."""
    line = _line(by)
    near = with_halo(df, "frame", len(weights) - 1, 0, chunk)
    y = sum((F.lit(float(w)) * F.coalesce(F.lag(value, k).over(line), F.lit(0.0)) for k, w in enumerate(weights)), F.lit(0.0))
    return _core(near.withColumn("y", y))


def autocorrelation(df: DataFrame, by: list[str], order: int, value: str = "v", chunk: int = CHUNK) -> DataFrame:
    """(by, lag, r): sum(v[t] * v[t - lag]) / (N - lag) for lag 0..order, the mean not removed."""
    return cross_correlation(df.withColumn("_w", F.col(value)), by, order, value, "_w", chunk)


def cross_correlation(df: DataFrame, by: list[str], order: int, x: str, y: str, chunk: int = CHUNK) -> DataFrame:
    """(by, lag, r): unbiased sum(x[t] * y[t - lag]) / (N - lag) for lag 0..order."""
    line = _line(by)
    near = with_halo(df, "frame", order, 0, chunk)
    products = _core(near.withColumns({f"_p{k}": F.col(x) * F.lag(y, k).over(line) for k in range(order + 1)}))
    sums = products.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(f"_p{k}").alias(f"s{k}") for k in range(order + 1)])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"s{k}").alias("s")) for k in range(order + 1)]))
    return sums.select(*by, "n", pairs.alias("p")).select(*by, "p.lag", F.try_divide(F.col("p.s"), F.col("n") - F.col("p.lag")).alias("r"))


def histogram(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, bin, n): floor(sqrt(count)) equal bins between the least and the greatest value, the last one closed."""
    clean = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    ends = clean.groupBy(*by).agg(F.min(value).alias("_a"), F.max(value).alias("_b"), F.floor(F.sqrt(F.count("*"))).alias("_k"))
    at = F.least(F.floor(F.try_divide(F.col(value) - F.col("_a"), (F.col("_b") - F.col("_a")) / F.col("_k"))), F.col("_k") - 1)
    return clean.join(ends, by).groupBy(*by, F.coalesce(at, F.lit(0)).alias("bin")).agg(F.count("*").alias("n"))


def neighbourhood_energy(df: DataFrame, half_rows: int, half_cols: int, half_frames: int, chunk: int = CHUNK) -> DataFrame:
    """(row, col, frame, energy): sum of v squared over a box around each voxel; boxes that leave the data give
    no row. The trace has the columns row, col, frame, v, without gaps in a sensor; sensors may end at different
    frames."""
    near = with_halo(df, "frame", half_frames, half_frames, chunk).withColumn("e", F.col("v") * F.col("v"))
    line = _line(["row", "col"]).rowsBetween(-half_frames, half_frames)
    near = near.withColumn("e", F.sum("e").over(line)).withColumn("_k", F.count("*").over(line))
    full = _core(near).filter(F.col("_k") == 2 * half_frames + 1)
    def offsets(h):
        return F.explode(F.sequence(F.lit(-h), F.lit(h)))
    moved = full.select("row", "col", "frame", "e", offsets(half_rows).alias("dr")).select("*", offsets(half_cols).alias("dc"))
    sums = moved.groupBy((F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"), "frame").agg(
        F.sum("e").alias("energy"), F.count("*").alias("_k")
    )
    return sums.filter(F.col("_k") == (2 * half_rows + 1) * (2 * half_cols + 1)).drop("_k")


def lowpass(times: int, half: int = 10, beta: float = 5.0) -> list[float]:
    """Interpolation filter for up-sampling: a windowed sinc of 2 * half * times + 1 taps (Kaiser window)."""
    import numpy as np

    at = np.arange(-half * times, half * times + 1)
    taps = np.sinc(at / times) * np.kaiser(len(at), beta)
    return (taps * times / taps.sum()).tolist()


def upsample(df: DataFrame, by: list[str], times: int, value: str = "v", half: int = 10, chunk: int = CHUNK) -> DataFrame:
    """(by, frame, v) at `times` the rate: frame f stands at (f - 1) * times + 1 and keeps its value up to the gain
    of the filter; frames between are interpolated. Beyond the ends the trace counts as 0."""
    taps = lowpass(times, half)
    line = _line(by)
    near = with_halo(df.select(*by, "frame", F.col(value).alias("v")), "frame", half, half, chunk)
    around = {k: F.coalesce(F.lag("v", -k).over(line), F.lit(0.0)) for k in range(-half, half + 1)}
    near = near.withColumns({f"_n{k + half}": c for k, c in around.items()})
    phases = [
        F.struct(F.lit(r).alias("r"), sum((F.col(f"_n{k + half}") * taps[r - k * times + half * times] for k in around if 0 <= r - k * times + half * times < len(taps)), F.lit(0.0)).alias("v"))
        for r in range(times)
    ]
    each = _core(near).select(*by, "frame", F.explode(F.array(*phases)).alias("p"))
    return each.select(*by, ((F.col("frame") - 1) * times + 1 + F.col("p.r")).alias("frame"), F.col("p.v").alias("v"))


def whitening_weights(model: list[float], tolerance: float = 1e-9, most: int = 512) -> list[float]:
    """Impulse response of z[t] = s[t] - sum(model[m] * z[t - m - 1]), cut where it stays below the tolerance; the
    recursion thus becomes a causal filter, which chunks of a trace can run side by side."""
    h = [1.0]
    while len(h) < most and max(abs(x) for x in h[-len(model) - 1 :]) > tolerance:
        h.append(-sum(a * h[-1 - m] for m, a in enumerate(model) if m < len(h)))
    if len(h) == most:
        raise ValueError("the recursion doesn't decay: its model isn't stable")
    return h


def least_peaks(seconds: float, frames: float, times_sigma: float, rate: float = 5.0) -> float:
    """Peaks that a component needs: `rate` a second, and those that noise alone gives beyond the threshold."""
    return rate * seconds + 0.5 * math.erfc(times_sigma / math.sqrt(2)) * frames


def template_snr(templates: DataFrame, sigma: DataFrame, by: list[str]) -> DataFrame:
    """(by, snr): the largest |v| of a template (by, lag, v) over the noise of the trace at its sensor (by, sigma)."""
    top = templates.groupBy(*by).agg(F.max(F.abs("v")).alias("_top"))
    return top.join(sigma.select(*by, "sigma"), by).select(*by, F.try_divide("_top", "sigma").alias("snr"))
