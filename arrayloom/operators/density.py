"""Densities of one-dimensional features from binned counts: isolation and mixtures.

Records are counted into the cells of a grid by Spark; what numpy gets of a group is that grid, whose size
does not depend on the number of records.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GRID = 1024


def _cells(df: DataFrame, by: list[str], value: str, cells: int, margin: float) -> DataFrame:
    """Adds cell and the ends of each group's grid, which is `margin` of the range wider on both sides."""
    clean = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    ends = clean.groupBy(*by).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    wide = F.greatest(F.col("_b") - F.col("_a"), F.lit(1e-9))
    ends = ends.select(*by, (F.col("_a") - margin * wide).alias("lo"), (F.col("_b") + margin * wide).alias("hi"))
    at = F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * cells)
    return clean.join(ends, by).withColumn("cell", F.greatest(F.lit(0), F.least(at, F.lit(cells - 1))).cast("int"))


def isolation(df: DataFrame, by: list[str], value: str, side: str) -> DataFrame:
    """(by, n_p, n_q, isolation): how far the values of side true and side false of each group stand apart.

    Both densities are Gaussian kernel estimates (Silverman's bandwidth) on one grid of GRID cells, 10 % of the
    range wider on both sides; with d and e their Kullback-Leibler divergences in bits, the isolation is
    d * e / (d + e), and 0 for equal densities. Null with fewer than 2 values on a side.
    """
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    counted = _cells(df, by, value, GRID, 0.1).groupBy(*by, "cell").agg(
        F.sum(F.when(F.col(side), 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(side), 0).otherwise(1)).alias("q")
    )

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        densities, sizes = [], []
        for c in ("p", "q"):
            counts = np.bincount(pdf["cell"], weights=pdf[c], minlength=GRID)
            n = counts.sum()
            sizes.append(int(n))
            if n < 2:
                continue
            x = np.arange(GRID)
            mean = counts @ x / n
            width = max(1.06 * np.sqrt(counts @ (x - mean) ** 2 / (n - 1)) * n**-0.2, 0.5)
            kernel = np.exp(-0.5 * ((np.arange(2 * GRID) - GRID) / width) ** 2)
            smooth = np.fft.irfft(np.fft.rfft(counts, 4 * GRID) * np.fft.rfft(kernel, 4 * GRID))[GRID : 2 * GRID]
            smooth = np.maximum(smooth, 0) / np.maximum(smooth, 0).sum() + 1e-10
            densities.append(smooth / smooth.sum())
        out = np.nan
        if len(densities) == 2:
            p, q = densities
            d, e = np.sum(p * np.log2(p / q)), np.sum(q * np.log2(q / p))
            out = d * e / (d + e) if d + e > 1e-12 else 0.0
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "n_p": [sizes[0]], "n_q": [sizes[1]], "isolation": [out]})

    return counted.groupBy(*by).applyInPandas(score, f"{kinds}, n_p bigint, n_q bigint, isolation double")


def mixtures(df: DataFrame, by: list[str], value: str, rounds: int = 100) -> DataFrame:
    """(by, component, weight, mean, sd): Gaussian mixture of each group's values. Fits start from the modes of their
    density, smoothed more and more; the one of best Bayesian information criterion is taken, of however many components.

    Values are counted into cells around the median: 1/64 of the quartiles' distance wide in the middle and growing with
    the distance from it (3 % of it), so a far value doesn't coarsen the others and a group has at most about 40 000 cells."""
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    clean = df.filter(F.col(value).isNotNull() & (F.abs(value) < float("inf")))
    quartiles = F.percentile_approx(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(1000))
    scale = clean.groupBy(*by).agg(quartiles.alias("_q"), F.max(value).alias("_b"), F.min(value).alias("_a"))
    between = F.col("_q")[2] - F.col("_q")[0]
    wide = F.when(between > 0, between).otherwise(F.greatest(1e-3 * (F.col("_b") - F.col("_a")), F.lit(1e-9))) / 2
    placed = clean.join(scale.select(*by, F.col("_q")[1].alias("_mid"), wide.alias("_wide")), by)
    placed = placed.withColumn("cell", F.floor(32 * F.asinh((F.col(value) - F.col("_mid")) / F.col("_wide"))))
    counted = placed.groupBy(*by, "cell").agg(F.count("*").alias("n"), F.avg(value).alias("x"), F.first("_wide").alias("wide"))

    def modes(pdf: pd.DataFrame, smooth: float) -> np.ndarray:
        """Cells at which the smoothed counts have a peak."""
        at = (pdf["cell"] - pdf["cell"].min()).to_numpy()
        reach = int(4 * smooth) + 1
        kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / smooth) ** 2)
        size = int(at.max()) + 1
        fast = 1 << int(np.ceil(np.log2(size + 2 * reach + 2)))
        dense = np.fft.irfft(np.fft.rfft(np.bincount(at, pdf["n"], size), fast) * np.fft.rfft(kernel, fast), fast)[reach : reach + size]
        padded = np.r_[-1, np.round(dense, 6), -1]
        return np.flatnonzero((padded[1:-1] > padded[:-2]) & (padded[1:-1] >= padded[2:]) & (padded[1:-1] > 1e-3))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell")
        x, n = pdf["x"].to_numpy(), pdf["n"].to_numpy(float)
        total, wide = n.sum(), pdf["wide"].iloc[0] / 32
        floor = max(wide, 1e-6)
        at = (pdf["cell"] - pdf["cell"].min()).to_numpy()
        best, tried = None, set()
        for smooth in (1e9, 128, 64, 32, 16, 8, 4, 2, 1):
            peaks = modes(pdf, smooth) if smooth < 1e9 else at[[int(np.searchsorted(np.cumsum(n), total / 2))]]
            if len(peaks) in tried or len(peaks) > 1 and 3 * len(peaks) > total:  # no more parameters than values
                continue
            tried.add(len(peaks))
            near = np.abs(at[:, None] - peaks).argmin(axis=1)
            mass = np.maximum(np.bincount(near, n, len(peaks)), 1e-12)
            mean = np.bincount(near, n * x, len(peaks)) / mass
            sd = np.maximum(np.sqrt(np.bincount(near, n * (x - mean[near]) ** 2, len(peaks)) / mass), floor)
            weight, fitted, last = mass / total, -np.inf, None
            for _ in range(rounds):
                last = fitted
                log = np.log(weight) - np.log(sd) - 0.5 * ((x[:, None] - mean) / sd) ** 2
                peak = log.max(axis=1, keepdims=True)
                part = np.exp(log - peak)
                norm = part.sum(axis=1, keepdims=True)
                fitted = float(n @ (np.log(norm[:, 0]) + peak[:, 0]))
                if fitted - last < 1e-4:
                    break
                part = part / norm * n[:, None]
                mass = np.maximum(part.sum(axis=0), 1e-12)
                weight, mean = mass / total, x @ part / mass
                sd = np.maximum(np.sqrt(np.sum(part * (x[:, None] - mean) ** 2, axis=0) / mass), floor)
            score = -2 * fitted + (3 * len(peaks) - 1) * np.log(total)
            if best is None or score < best[0] - 1e-9:
                best = (score, weight, mean, sd)
        at = np.argsort(best[2])
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(at) for c in by}, "component": np.arange(len(at)), "weight": best[1][at], "mean": best[2][at], "sd": best[3][at]})

    return counted.groupBy(*by).applyInPandas(fit, f"{kinds}, component int, weight double, mean double, sd double")


def assign(df: DataFrame, models: DataFrame, by: list[str], value: str, key: str) -> DataFrame:
    """(by, key, value, component): the most likely component of each value (ties to the smaller). A group's components
    travel as one array, so no row is shuffled beyond the join with its group's model."""
    packed = models.groupBy(*by).agg(F.collect_list(F.struct("component", "weight", "mean", "sd")).alias("_m"))
    log = lambda m: F.ln(m["weight"]) - F.ln(m["sd"]) - 0.5 * ((F.col(value) - m["mean"]) / m["sd"]) ** 2
    best = F.array_max(F.transform("_m", lambda m: F.struct(log(m).alias("l"), (-m["component"]).alias("c"))))
    return df.select(*by, key, value).join(packed, by).select(*by, key, value, (-best["c"]).alias("component"))


def roles(assigned: DataFrame, by: list[str], value: str, scores: DataFrame | None = None, tight: float = 0.05) -> DataFrame:
    """(by, component, role): which components are the winner, the nearest and others of each group. Components are ranked
    by score (by, component, score: the length of their mean waveform), or by mean |value| without scores; ties to the
    smaller. The second one is taken into the winner, once, if the first one's relative spread is at most `tight` or its
    mean |value| isn't above the second one's; the nearest is the next in rank."""
    stats = assigned.groupBy(*by, "component").agg(F.avg(F.abs(value)).alias("m"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("s"))
    stats = stats.withColumn("score", F.col("m")) if scores is None else stats.join(scores.select(*by, "component", "score"), [*by, "component"])
    line = Window.partitionBy(*by).orderBy(F.desc("score"), "component")  # over the components of a group
    ranked = stats.withColumn("rank", F.row_number().over(line)).withColumn("below", F.lead("m").over(line))
    takes = (F.col("rank") == 1) & F.col("below").isNotNull() & ((F.try_divide("s", "m") <= tight) | (F.col("m") <= F.col("below")))
    ranked = ranked.withColumn("merged", F.max(F.coalesce(takes, F.lit(False)).cast("int")).over(Window.partitionBy(*by)))
    role = F.when(F.col("rank") <= 1 + F.col("merged"), "winner").when(F.col("rank") == 2 + F.col("merged"), "nearest").otherwise("other")
    return ranked.select(*by, "component", role.alias("role"))


def winners(assigned: DataFrame, by: list[str], value: str, noise: DataFrame, scores: DataFrame | None = None, tight: float = 0.05) -> DataFrame:
    """(by, n, mean_amp, amplitude_sd, rstd, separability, components) of each group's winner (see roles). separability is the
    distance of its mean |value| from that of the nearest component, from 0 if there is none, over the noise (by,
    noise_std). components counts those left after the merge."""
    named = assigned.join(roles(assigned, by, value, scores, tight), [*by, "component"])
    own, size = F.col("role") == "winner", F.abs(value)
    out = named.groupBy(*by).agg(
        F.count(F.when(own, 1)).alias("n"), F.avg(F.when(own, size)).alias("mean_amp"),
        F.coalesce(F.stddev_samp(F.when(own, F.col(value))), F.lit(0.0)).alias("amplitude_sd"),
        F.coalesce(F.avg(F.when(F.col("role") == "nearest", size)), F.lit(0.0)).alias("_near"),
        (F.count_distinct(F.when(~own, F.col("component"))) + 1).alias("components"),
    ).join(noise.select(*by, "noise_std"), by)
    out = out.withColumn("rstd", F.try_divide("amplitude_sd", "mean_amp")).withColumn("separability", F.try_divide(F.col("mean_amp") - F.col("_near"), F.col("noise_std")))
    return out.select(*by, "n", "mean_amp", "amplitude_sd", "rstd", "separability", "components")


def winner_isolation(assigned: DataFrame, by: list[str], value: str, scores: DataFrame | None = None, tight: float = 0.05) -> DataFrame:
    """(by, iso_nn, iso_bg): isolation of each group's winner from the nearest component and from all others; null for a
    group of one component."""
    named = assigned.join(roles(assigned, by, value, scores, tight), [*by, "component"]).withColumn("side", F.col("role") == "winner")
    near = isolation(named.filter("role <> 'other'"), by, value, "side").select(*by, F.col("isolation").alias("iso_nn"))
    return near.join(isolation(named, by, value, "side").select(*by, F.col("isolation").alias("iso_bg")), by)
