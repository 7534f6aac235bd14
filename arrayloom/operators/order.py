"""How many sources a spectrum holds: five rules over sorted values, per group, as windows and sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked_spectrum(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, i, x, n): values in descending order with their place and number. Null and NaN take no part."""
    clean = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, F.col(value).alias("x"))
    line = Window.partitionBy(*by).orderBy(F.desc("x"))
    return clean.withColumn("i", F.row_number().over(line)).withColumn("n", F.count("*").over(Window.partitionBy(*by)))


def _first(condition: Column) -> Column:
    return F.min(F.when(condition, F.col("i")))


def order_estimates(df: DataFrame, by: list[str], value: str, samples: float) -> DataFrame:
    """(by, n, by_median, by_mean, by_line, by_aic, by_mdl): null where a rule finds nothing.

    by_median: first value below twice the median less the minimum; by_mean: first value not above the mean;
    by_line: first value below the line through the second half plus three times the norm of its residuals;
    by_aic and by_mdl: information criteria of the values behind each place, over `samples` observations.
    """
    s = ranked_spectrum(df, by, value)
    tail = F.col("i") >= F.round(F.col("n") / 2)
    stats = s.groupBy(*by).agg(
        F.median("x").alias("mid"), F.avg("x").alias("mean"), F.min("x").alias("least"),
        F.regr_slope(F.when(tail, F.col("x")), F.when(tail, F.col("i").cast("double"))).alias("slope"),
        F.regr_intercept(F.when(tail, F.col("x")), F.when(tail, F.col("i").cast("double"))).alias("at0"),
    )
    s = s.join(stats, by)
    line = F.col("at0") + F.col("slope") * F.col("i")
    norm = s.filter(tail).groupBy(*by).agg(F.sqrt(F.sum((F.col("x") - line) ** 2)).alias("norm"))
    behind = Window.partitionBy(*by).orderBy("i").rowsBetween(1, Window.unboundedFollowing)
    k = F.col("n") - F.col("i")
    rho = F.try_divide(F.exp(F.avg(F.ln(F.when(F.col("x") > 0, F.col("x")))).over(behind)), F.avg("x").over(behind))
    s = s.join(norm, by).withColumn("fit", -samples * k * F.ln(rho))
    free = F.col("i") * (2 * F.col("n") - F.col("i"))
    inside = F.col("i") < F.col("n")
    return s.withColumn("aic", 2 * F.col("fit") + 2 * free).withColumn("mdl", F.col("fit") + 0.5 * free * F.ln(F.lit(float(samples)))).groupBy(*by).agg(
        F.first("n").alias("n"), _first(F.col("x") < 2 * F.col("mid") - F.col("least")).alias("by_median"),
        _first(F.col("x") <= F.col("mean")).alias("by_mean"), _first(F.col("x") < line + 3 * F.col("norm")).alias("by_line"),
        F.min(F.when(inside & F.col("aic").isNotNull(), F.struct("aic", "i")))["i"].alias("by_aic"),
        F.min(F.when(inside & F.col("mdl").isNotNull(), F.struct("mdl", "i")))["i"].alias("by_mdl"),
    )


def order_by_kde(df: DataFrame, by: list[str], value: str, cells: int = 256) -> DataFrame:
    """(by, mode, by_kde): the mode of each group's spectrum and the first place below twice the mode less the minimum, or all
    places if the mode isn't above the minimum. The density is a sum of Gaussians (Silverman's bandwidth) at `cells` points
    from the least to the largest value; equal densities: the smaller point. Spectra of one value have that as mode."""
    s = ranked_spectrum(df, by, value)
    ends = s.groupBy(*by).agg(
        F.min("x").alias("least"), F.max("x").alias("top"), F.max("n").alias("n"),
        (1.06 * F.coalesce(F.stddev_samp("x"), F.lit(0.0)) * F.pow(F.count("*"), F.lit(-0.2))).alias("width"),
    )
    at = F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("at")
    points = s.join(ends.drop("n"), by).select(*by, "x", "least", "top", "width", at)
    point = F.col("least") + (F.col("top") - F.col("least")) * F.col("at") / (cells - 1)
    height = F.exp(-0.5 * F.try_divide(F.col("x") - point, F.col("width")) ** 2)
    density = points.groupBy(*by, "at").agg(F.round(F.sum(height), 9).alias("d"), F.first(point).alias("p"))
    mode = density.groupBy(*by).agg(F.max(F.struct(F.coalesce("d", F.lit(0.0)).alias("d"), (-F.col("at")).alias("a"), "p"))["p"].alias("mode"))
    found = s.drop("n").join(mode, by).join(ends.select(*by, "least", "n"), by)
    first = F.min(F.when(F.col("x") < 2 * F.col("mode") - F.col("least"), F.col("i")))
    return found.groupBy(*by, "mode", "least", "n").agg(first.alias("first")).select(*by, "mode", F.when(F.col("mode") <= F.col("least"), F.col("n")).otherwise(F.col("first")).cast("int").alias("by_kde"))
