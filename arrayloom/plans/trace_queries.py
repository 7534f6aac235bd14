"""Queries of the trace operators; `events` stands for a recording: one channel per user, in order of time."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayloom.functions import signal as S
from arrayloom.operators.units import numbered_within
from arrayloom.session import write_through
from arrayloom.sources.tables import table

BY = ["channel"]
_X = """X AS (SELECT user_id AS channel, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame, -value AS v FROM events),
    SIG AS (SELECT channel, median(abs(v)) / 0.6745 AS sigma FROM X GROUP BY channel)"""
_P = _X + """,
    L AS (SELECT X.*, lag(v) OVER w AS a, lead(v) OVER w AS b, max(frame) OVER (PARTITION BY channel) AS last FROM X WINDOW w AS (PARTITION BY channel ORDER BY frame)),
    P AS (SELECT channel, frame, v, sigma, last FROM L JOIN SIG USING (channel) WHERE -v > 2 * sigma AND -v > -a AND -v >= -b)"""
_SNIP = _P + """,
    W AS (SELECT p.channel, p.frame AS spike, X.frame - p.frame AS lag, X.v FROM P p JOIN X ON X.channel = p.channel
          AND X.frame BETWEEN p.frame - 2 AND p.frame + 3 WHERE p.frame - 2 >= 1 AND p.frame + 3 <= p.last)"""


def traces(spark: SparkSession, folder: str) -> DataFrame:
    """The recording, written once, as queries read it several times."""
    events = table(spark, folder, "events").select(F.col("user_id").alias("channel"), "ts", "event_id", (-F.col("value")).alias("v"))
    return write_through(numbered_within(events, BY, ["ts", "event_id"], "frame").select("channel", "frame", "v"))


def on_traces(query: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query of the recording as a query of a folder."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return query(traces(spark, folder))

    return wraps(query)(run)


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _peaks(x: DataFrame) -> DataFrame:
    return S.peaks(x, BY, 2.0)


def _windows(x: DataFrame) -> DataFrame:
    return S.snippets(x, _peaks(x), BY, 2, 3)


@on_traces
def spike_quality(x):
    """Spikes of each channel, the spread of their amplitudes and their distance from the noise."""
    size = F.avg(F.abs("v"))
    out = _peaks(x).groupBy("channel").agg(
        F.count("*").alias("n_spikes"), size.alias("mean_amp"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("amplitude_sd"),
        F.try_divide(F.coalesce(F.stddev_samp("v"), F.lit(0.0)), size).alias("rstd"), F.try_divide(size, F.first("sigma")).alias("separability"),
    )
    return _round(out, "mean_amp", "amplitude_sd", "rstd", "separability")


@on_traces
def component_filter(x):
    """Channels split into kept ones and noise by skewness and number of peaks."""
    x = S.sign_correct(x, BY)
    n = S.peaks(x, BY, 2.0).groupBy("channel").agg(F.count("*").alias("peaks"))
    out = S.moments(x, BY).join(n, "channel", "left").withColumn("peaks", F.coalesce("peaks", F.lit(0)))
    keep = (F.abs("skewn") > 0.2) & (F.col("peaks") >= 3)
    return _round(out.select("channel", "skewn", "peaks", F.when(keep, "kept").otherwise("noise").alias("status")), "skewn")


@on_traces
def onset_peaks(x):
    return S.onset_peaks(x.withColumn("v", -F.col("v")), BY, F.lit(100.0), 4)


@on_traces
def dilate_mask(x):
    ends = x.groupBy("channel").agg(F.max("frame").alias("total"))
    seeds = _peaks(x).select("channel", "frame", F.lit(True).alias("seed"))
    x = x.join(seeds, ["channel", "frame"], "left").join(ends, "channel").withColumn("seed", F.coalesce("seed", F.lit(False)))
    return S.dilate(x, BY, "seed", 2, "total").filter("mask").select("channel", "frame")


@on_traces
def autocorr(x):
    return S.autocorrelation(x, BY, 5).withColumn("r", F.round("r", 3))


@on_traces
def amplitude_histogram(x):
    return S.histogram(x, BY, "v")


def grid_traces(spark, folder):
    """A 10-row grid of the channels, each with all of its frames."""
    x = traces(spark, folder)
    return x.select((F.col("channel") % 10 + 1).alias("row"), F.expr("channel div 10 + 1").alias("col"), "frame", "v")


def stencil_energy(spark, folder):
    return _round(S.neighbourhood_energy(grid_traces(spark, folder), 1, 1, 1), "energy")


def active_box(spark, folder):
    """Sensors with at least 3 voxels of high energy, and the box around them."""
    z = S.center_scale(grid_traces(spark, folder), ["row", "col"]).select("row", "col", "frame", F.col("z").alias("v"))
    cross = S.neighbourhood_energy(z, 1, 1, 1).filter("energy > 60")
    active = cross.groupBy("row", "col").count().filter("count >= 3")
    return active.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("row", "col") for f in (F.min, F.max)], F.count("*").alias("sensors"))


QUERIES = {
    "spike_quality": spike_quality,
    "noise_sigma": on_traces(lambda x: _round(S.noise_sigma(x, BY), "sigma")),
    "center_scale": on_traces(lambda x: _round(S.center_scale(x, BY).select("channel", "frame", "z"), "z")),
    "moments": on_traces(lambda x: _round(S.moments(x, BY), "skewn", "kurt")),
    "sign_correct": on_traces(lambda x: S.sign_correct(x, BY)),
    "peaks": on_traces(lambda x: _round(_peaks(x), "sigma")),
    "component_filter": component_filter,
    "onset_peaks": onset_peaks,
    "dilate_mask": dilate_mask,
    "lag_embed": on_traces(lambda x: S.lag_embed(x, BY, 3)),
    "snippets": on_traces(_windows),
    "sta": on_traces(lambda x: _round(S.template(_windows(x), BY), "v")),
    "weighted_sta": on_traces(lambda x: _round(S.template(_windows(x), BY, 1 / F.col("spike")), "v")),
    "waveform_spread": on_traces(lambda x: _round(S.waveform_spread(_windows(x), BY), "sd_score", "norm")),
    "fir_causal": on_traces(lambda x: _round(S.fir(x, BY, [0.5, -0.25, 0.125]).select("channel", "frame", "y"), "y")),
    "autocorr_unbiased": autocorr,
    "histogram_sqrt": amplitude_histogram,
    "stencil_energy": stencil_energy,
    "active_box": active_box,
}

_GRID = _X + """,
    G AS (SELECT channel % 10 + 1 AS row, channel // 10 + 1 AS col, frame, v FROM X)"""
_BOX = """SELECT a.row, a.col, a.frame, sum(b.v * b.v) AS energy FROM {g} a JOIN {g} b
    ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 AND b.frame BETWEEN a.frame - 1 AND a.frame + 1
    GROUP BY ALL HAVING count(*) = 27"""
_MOM = """SELECT channel, avg(pow(v - m, 3)) / pow(avg(pow(v - m, 2)), 1.5) AS skewn, avg(pow(v - m, 4)) / pow(avg(pow(v - m, 2)), 2) AS kurt
    FROM {x} JOIN (SELECT channel, avg(v) AS m FROM {x} GROUP BY channel) USING (channel) GROUP BY channel"""

SQL = {
    "spike_quality": f"""WITH {_P} SELECT channel, count(*) AS n_spikes, round(avg(abs(v)), 6) AS mean_amp, round(coalesce(stddev_samp(v), 0), 6) AS amplitude_sd,
        round(coalesce(stddev_samp(v), 0) / avg(abs(v)), 6) AS rstd, round(avg(abs(v)) / any_value(sigma), 6) AS separability FROM P GROUP BY channel""",
    "noise_sigma": f"WITH {_X} SELECT channel, round(sigma, 6) AS sigma FROM SIG",
    "center_scale": f"""WITH {_X}, C AS (SELECT *, v - avg(v) OVER (PARTITION BY channel) AS c FROM X)
        SELECT channel, frame, round(c / nullif(median(abs(c)) OVER (PARTITION BY channel) / 0.6745, 0), 6) AS z FROM C""",
    "moments": f"WITH {_X}, M AS ({_MOM.format(x='X')}) SELECT channel, round(skewn, 6) AS skewn, round(kurt, 6) AS kurt FROM M",
    "sign_correct": f"WITH {_X}, M AS ({_MOM.format(x='X')}) SELECT channel, frame, CASE WHEN skewn > 0 THEN -v ELSE v END AS v FROM X JOIN M USING (channel)",
    "peaks": f"WITH {_P} SELECT channel, frame, v, round(sigma, 6) AS sigma FROM P",
    "component_filter": f"""WITH {_X}, M AS ({_MOM.format(x='X')}), Y AS (SELECT channel, frame, CASE WHEN skewn > 0 THEN -v ELSE v END AS v FROM X JOIN M USING (channel)),
        L AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM Y WINDOW w AS (PARTITION BY channel ORDER BY frame)),
        N AS (SELECT channel, count(*) AS n FROM L JOIN SIG USING (channel) WHERE -v > 2 * sigma AND -v > -a AND -v >= -b GROUP BY channel),
        R AS (SELECT channel, CASE WHEN skewn > 0 THEN -skewn ELSE skewn END AS skewn, coalesce(n, 0) AS peaks FROM M LEFT JOIN N USING (channel))
        SELECT channel, round(skewn, 6) AS skewn, peaks, CASE WHEN abs(skewn) > 0.2 AND peaks >= 3 THEN 'kept' ELSE 'noise' END AS status FROM R""",
    "onset_peaks": f"""WITH {_X}, L AS (SELECT channel, frame, -v AS v, lead(-v) OVER w AS nxt, list({{'v': -v, 'f': frame}}) OVER (PARTITION BY channel ORDER BY frame ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS l
            FROM X WINDOW w AS (PARTITION BY channel ORDER BY frame)),
        O AS (SELECT channel, frame AS onset, unnest(l) AS p FROM L WHERE v <= 100 AND nxt > 100)
        SELECT channel, onset, arg_max(p.f, (p.v, -p.f)) AS frame, max(p.v) AS peak FROM O GROUP BY channel, onset""",
    "dilate_mask": f"""WITH {_P}, E AS (SELECT channel, max(frame) AS total FROM X GROUP BY channel)
        SELECT DISTINCT channel, unnest(CASE WHEN frame > 2 AND frame + 2 <= total THEN range(frame - 2, frame + 3) ELSE [frame] END) AS frame FROM P JOIN E USING (channel)""",
    "lag_embed": f"""WITH {_X}, E AS (SELECT channel, max(frame) AS last FROM X GROUP BY channel)
        SELECT x.channel, x.frame, lag::INT AS lag, CASE WHEN x.frame > last - 3 THEN 0 ELSE y.v END AS v
        FROM X x JOIN E USING (channel) CROSS JOIN (SELECT unnest(range(0, 3)) AS lag) LEFT JOIN X y ON y.channel = x.channel AND y.frame = x.frame + lag""",
    "snippets": f"WITH {_SNIP} SELECT * FROM W",
    "sta": f"WITH {_SNIP} SELECT channel, lag, round(avg(v), 6) AS v FROM W GROUP BY channel, lag",
    "weighted_sta": f"WITH {_SNIP} SELECT channel, lag, round(sum(v / spike) / sum(1 / spike), 6) AS v FROM W GROUP BY channel, lag",
    "waveform_spread": f"""WITH {_SNIP}, A AS (SELECT channel, lag, coalesce(stddev_samp(v), 0) AS s, avg(v) AS m FROM W GROUP BY channel, lag)
        SELECT channel, round(max(s), 6) AS sd_score, round(sqrt(sum(m * m)), 6) AS norm FROM A GROUP BY channel""",
    "fir_causal": f"""WITH {_X} SELECT channel, frame, round(0.5 * v - 0.25 * coalesce(lag(v) OVER w, 0) + 0.125 * coalesce(lag(v, 2) OVER w, 0), 6) AS y
        FROM X WINDOW w AS (PARTITION BY channel ORDER BY frame)""",
    "autocorr_unbiased": f"""WITH {_X}, N AS (SELECT channel, count(*) AS n FROM X GROUP BY channel), K AS (SELECT unnest(range(0, 6)) AS lag)
        SELECT x.channel, lag::INT AS lag, round(sum(x.v * y.v) / (any_value(n) - lag), 3) AS r
        FROM X x JOIN N USING (channel) CROSS JOIN K JOIN X y ON y.channel = x.channel AND y.frame = x.frame - lag GROUP BY x.channel, lag""",
    "histogram_sqrt": f"""WITH {_X}, E AS (SELECT channel, min(v) AS a, max(v) AS b, floor(sqrt(count(*))) AS k FROM X GROUP BY channel)
        SELECT channel, coalesce(least(floor((v - a) / nullif((b - a) / k, 0)), k - 1), 0)::BIGINT AS bin, count(*) AS n FROM X JOIN E USING (channel) GROUP BY ALL""",
    "stencil_energy": f"WITH {_GRID} SELECT row, col, frame, round(energy, 6) AS energy FROM ({_BOX.format(g='G')})",
    "active_box": f"""WITH {_GRID}, C2 AS (SELECT *, v - avg(v) OVER (PARTITION BY row, col) AS c FROM G),
        Z AS (SELECT row, col, frame, c / (median(abs(c)) OVER (PARTITION BY row, col) / 0.6745) AS v FROM C2),
        A AS (SELECT row, col FROM ({_BOX.format(g='Z')}) WHERE energy > 60 GROUP BY row, col HAVING count(*) >= 3)
        SELECT min(row) AS min_row, max(row) AS max_row, min(col) AS min_col, max(col) AS max_col, count(*) AS sensors FROM A""",
}
