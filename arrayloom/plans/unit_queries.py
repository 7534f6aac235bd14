"""Queries of the unit operators (alignment, redundancy, quality) and of regions, masks and sources, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayloom.functions import signal as S
from arrayloom.operators import density as N
from arrayloom.operators import events as E
from arrayloom.operators import joins as J
from arrayloom.operators import units as U
from arrayloom.operators.order import order_by_kde
from arrayloom.plans.relation_queries import _ACT, _FRAC, _ONCE, _P4, _PEAK, _REG, _S, _SETS, _T, _U, _once, _pairs, _regions, _sets, _templates, _units, block_sizes
from arrayloom.plans.relation_queries import _components as components_sql
from arrayloom.plans.relation_queries import SQL as RELATION_SQL
from arrayloom.plans.trace_queries import _BOX, _GRID, _SNIP, BY, _round, _windows, grid_traces, on_traces
from arrayloom.session import scratch_path, write_through
from arrayloom.sources.recording import read_box, recordings, write_traces
from arrayloom.sources.tables import table
from arrayloom.sources.text_tables import read_events, write_result

PITCH = 7.4
#: Frames a millisecond of the recordings that the events come from.
RATE = 11.7


def _spikes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "unit_spikes").select("spike_id", "unit_id", "time", "amplitude")


def shifted_coincidences(spark, folder):
    """Coincidences of compared units within 1 ms after the shift of at most 0.5 ms at which most spikes meet."""
    return _round(U.shifted_coincidences(_spikes(spark, folder), _pairs(spark, folder), 0.25, 2, 1.0), "frac_a", "frac_b")


def redundancy_search(spark, folder):
    """Units that are the same neuron, from trains and templates, and which of each group is kept."""
    units = _units(spark, folder)
    groups = U.redundancy_groups(units, _spikes(spark, folder), _templates(spark, folder), "boss_row", "boss_col", 3.0, 0.25, 2, 1.0, 0.5, 0.5)
    return U.keep_best(units.select("unit_id", "separability").join(groups, "unit_id"), "component", "separability").select("unit_id", "component", "keep")


def _clustered(x: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spikes of each channel with a level of amplitude as component, and the length of each level's mean waveform."""
    windows = write_through(_windows(x))
    sigma = S.noise_sigma(x, BY)
    spikes = windows.filter("lag = 0").join(sigma, BY).withColumn("component", F.least(F.floor(F.try_divide(-F.col("v"), F.col("sigma"))), F.lit(6)).cast("int"))
    spikes = write_through(spikes.select("channel", "spike", "v", "sigma", "component"))
    score = S.waveform_spread(windows.join(spikes.select("channel", "spike", "component"), ["channel", "spike"]), ["channel", "component"])
    return spikes, score.select("channel", "component", F.col("norm").alias("score"))


@on_traces
def winner_quality(x):
    """The winning level of each channel's spikes by waveform, and how far it stands from the nearest one."""
    spikes, score = _clustered(x)
    noise = spikes.groupBy("channel").agg(F.first("sigma").alias("noise_std"))
    out = N.winners(spikes, BY, "v", noise, score)
    return _round(out, "mean_amp", "amplitude_sd", "rstd", "separability")


@on_traces
def trace_snr(x):
    """Extremum of each channel's spike-triggered average over the noise of its trace."""
    return _round(S.template_snr(S.template(_windows(x), BY), S.noise_sigma(x, BY), BY), "snr")


def rethreshold(spark, folder):
    """Units whose threshold is moved to four times their noise."""
    limits = _units(spark, folder).select("unit_id", "noise_std", (-4 * F.col("noise_std")).alias("threshold"))
    out = U.rethreshold(_spikes(spark, folder).distinct(), limits, ["unit_id"])
    return out.withColumns({c: F.round(c, 9) for c in ("mean_amp", "amplitude_sd", "rstd", "separability")})


def backfilled_units(spark, folder):
    """Units with missing features taken from their spikes: relative spread and the moments of the amplitudes."""
    spikes = _spikes(spark, folder).filter("amplitude IS NOT NULL AND NOT isnan(amplitude)").distinct()
    sd, size = F.coalesce(F.stddev_samp("amplitude"), F.lit(0.0)), F.avg(F.abs("amplitude"))
    computed = S.moments(spikes, ["unit_id"], "amplitude").join(spikes.groupBy("unit_id").agg(F.try_divide(sd, size).alias("rstd"), F.try_divide(size, sd).alias("iso_i_nn")), "unit_id")
    units = _units(spark, folder).select("unit_id", "skewn", "kurt", "rstd", "iso_i_nn")
    return _round(U.backfill(units, computed, ["unit_id"], ["skewn", "kurt", "rstd", "iso_i_nn"]), "skewn", "kurt", "rstd", "iso_i_nn")


def units_by_feature(spark, folder):
    return U.ordered_units(_units(spark, folder), ["roi_id"], "iso_i_nn").select("roi_id", "unit_id", "rank")


def lag_product_pairs(spark, folder):
    """Cauchy product over the lags of the templates of compared units."""
    t = _templates(spark, folder).filter("v IS NOT NULL AND NOT isnan(v)").select("unit_id", "sensor_row", "sensor_col", "lag", "v").distinct()
    pairs = _pairs(spark, folder)
    a = pairs.join(t.withColumnRenamed("unit_id", "a"), "a")
    b = pairs.join(t.withColumnRenamed("unit_id", "b"), "b")
    return _round(U.lag_product(a, b, ["a", "b"]), "v")


def largest_block(spark, folder):
    """The spatial block of most units, the smallest of equals."""
    return block_sizes(spark, folder).agg(F.max(F.struct("units", (-F.col("component")).alias("c"))).alias("b")).select((-F.col("b.c")).alias("component"), "b.units")


def kde_order(spark, folder):
    """Order estimate by the mode of the density of the spectra of order_rules."""
    spikes = _spikes(spark, folder).filter("amplitude IS NOT NULL AND NOT isnan(amplitude)").select("spike_id", "unit_id", "amplitude").distinct()
    power = spikes.groupBy("unit_id").agg(F.avg(F.col("amplitude") ** 2).alias("x"))
    return _round(order_by_kde(power.join(_units(spark, folder).select("unit_id", "roi_id"), "unit_id"), ["roi_id"], "x"), "mode")


def dense_counts(spark, folder):
    return E.dense_counts(_once(spark, folder), "boss_row", "boss_column")


def _active(spark, folder):
    return E.active_sensors(_once(spark, folder), "boss_row", "boss_column", 20)


def region_times(spark, folder):
    return E.region_times(_once(spark, folder), _active(spark, folder), "time")


def filled_regions(spark, folder):
    """Region sensors of an array read out in every second column: the column behind each sensor joins in."""
    return _regions(spark, folder, fill=True)


def _mask(spark, folder):
    times = E.region_times(_once(spark, folder), _active(spark, folder), "time")
    return E.frame_mask(times.select(F.round(F.col("time") * RATE).alias("frame")), 2)


def frame_mask(spark, folder):
    return _mask(spark, folder)


def masked_spikes(spark, folder):
    """Known spikes at a sensor of a region and in the frame mask."""
    spikes = table(spark, folder, "true_spikes").filter("time IS NOT NULL AND NOT isnan(time)").select("gt_id", F.col("sensor_row").alias("row"), F.col("sensor_col").alias("col"), F.round(F.col("time") * RATE).cast("long").alias("frame"))
    return E.masked(spikes.distinct(), _regions(spark, folder), _mask(spark, folder)).select("gt_id", "frame")


def data_positions(spark, folder):
    """Places of the events' boss sensors among the rows and columns in use."""
    events = _once(spark, folder).filter("boss_row IS NOT NULL AND boss_column IS NOT NULL").select("event_id", "boss_row", "boss_column")
    ids = events.select(F.lit("row").alias("kind"), F.col("boss_row").alias("id")).unionByName(events.select(F.lit("col").alias("kind"), F.col("boss_column").alias("id")))
    return J.positions(events, "boss_row", "boss_column", ids).select("event_id", "row_at", "col_at")


def expected_components(spark, folder):
    return E.expected_components(_regions(spark, folder), ["roi_row", "roi_col"], PITCH, PITCH)


def active_frames(spark, folder):
    """Voxels of high energy in each frame."""
    z = S.center_scale(grid_traces(spark, folder), ["row", "col"]).select("row", "col", "frame", F.col("z").alias("v"))
    return S.neighbourhood_energy(z, 1, 1, 1).filter("energy > 60").groupBy("frame").agg(F.count("*").alias("voxels"))


def equal_regions(spark, folder):
    """Regions of one file that have the same sensors, named by the first of them."""
    sets = _sets(spark, folder, "filename").select(F.concat_ws("#", "filename", "roi").alias("region"), "pixel")
    return J.set_classes(sets, "region", "pixel")


def event_list(spark, folder):
    """Events written as the tab-separated list of a recording and read again."""
    path = scratch_path(spark)
    write_result(table(spark, folder, "basic_events").select("filename", "place", "time", "amplitude", "boss_column", "boss_row", "sensors"), path)
    return read_events(spark, path).fillna(-1, ["boss_column", "boss_row"]).groupBy("boss_column", "boss_row").agg(F.count("*").alias("n"), F.count("sensors").alias("packed"), F.max("time").alias("last"))


def trace_box(spark, folder):
    """A box of the recording, read from its tiles."""
    path = scratch_path(spark)
    write_traces(grid_traces(spark, folder).withColumn("rec_id", F.lit("r")), path)
    return read_box(spark, path, "r", (3, 7), (2, 20), (5, 40)).select("row", "col", "frame", "v")


def recording_facts(spark, folder):
    """Rate, sensor lists and pitch of each file as a recording."""
    events = _once(spark, folder, "filename").filter("filename IS NOT NULL")
    frames = events.select(F.col("filename").alias("rec_id"), F.col("time").alias("t_ms")).filter("t_ms IS NOT NULL AND NOT isnan(t_ms)")
    sensors = events.select(F.col("filename").alias("rec_id"), F.col("boss_row").alias("row"), F.col("boss_column").alias("col"))
    chips = events.select(F.col("filename").alias("rec_id")).distinct().withColumn("chip", F.lit("G1183")).withColumn("version", F.lit("NH5_1.0.0"))
    out = recordings(frames, sensors, chips)
    return out.select("rec_id", "frames", F.round("sr_khz", 6).alias("sr_khz"), F.size("rows").alias("rows"), F.size("cols").alias("cols"), "pitch")


def least_peaks(spark, folder):
    """Peaks that a component of each file needs at a threshold of three."""
    spans = _once(spark, folder, "filename").groupBy("filename").agg((F.max("time") - F.min("time")).alias("span"))
    each = S.least_peaks(1e-3, RATE, 3.0)  # of a millisecond
    return spans.select("filename", F.round(F.col("span") * each, 6).alias("least"))


QUERIES = {f.__name__: f for f in (
    shifted_coincidences, redundancy_search, winner_quality, trace_snr, rethreshold, backfilled_units, units_by_feature, lag_product_pairs, largest_block, kde_order,
    dense_counts, region_times, filled_regions, frame_mask, masked_spikes, data_positions, expected_components, active_frames, equal_regions, event_list, trace_box, recording_facts, least_peaks,
)}

_LAGS = f"""{_FRAC}, CN AS (SELECT unit_id, floor(time / 0.25)::BIGINT AS bin, count(*) AS n FROM V GROUP BY ALL),
    LG AS (SELECT a, b, (x.bin - y.bin)::INT AS lag, sum(x.n * y.n) AS n FROM PR JOIN CN x ON x.unit_id = a JOIN CN y ON y.unit_id = b AND y.bin BETWEEN x.bin - 2 AND x.bin + 2 GROUP BY ALL),
    BL AS (SELECT PR.a, PR.b, coalesce(lag, 0) AS lag FROM PR LEFT JOIN (SELECT * FROM LG QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY n DESC, lag) = 1) USING (a, b)),
    SM AS (SELECT a, b, lag, x.spike_id FROM BL JOIN V x ON x.unit_id = a JOIN V y ON y.unit_id = b AND y.time BETWEEN x.time - 2 AND x.time + 2 WHERE abs(x.time - (y.time + lag * 0.25)) <= 1 GROUP BY ALL HAVING count(*) = 1),
    SC AS (SELECT a, b, lag, count(*) AS n, count(*) / any_value(p.n) AS frac_a, count(*) / any_value(q.n) AS frac_b FROM SM JOIN N p ON p.unit_id = a JOIN N q ON q.unit_id = b GROUP BY a, b, lag)"""
_NEAR3 = "SELECT x.unit_id AS a, y.unit_id AS b FROM U x JOIN U y ON x.unit_id < y.unit_id AND (x.boss_row - y.boss_row) ** 2 + (x.boss_col - y.boss_col) ** 2 <= 9"
#: Pairs of one block take the place of the compared pairs.
_BLOCK_LAGS = _LAGS.split("PR AS (")[0].rstrip().rstrip(",") + ", PR AS (SELECT x.unit_id AS a, y.unit_id AS b FROM CC x JOIN CC y ON x.component = y.component AND x.unit_id < y.unit_id)" + _LAGS[_LAGS.index(", V AS ("):]
_MASK = f"""FR AS (SELECT DISTINCT round(time * {RATE})::BIGINT AS frame FROM B JOIN A20 USING (boss_row, boss_column) WHERE time IS NOT NULL),
    MX AS (SELECT max(frame) AS last FROM FR),
    MASK AS (SELECT DISTINCT unnest(CASE WHEN frame > 2 AND frame + 2 <= last THEN range(frame - 2, frame + 3) ELSE [frame] END) AS frame FROM FR, MX WHERE frame >= 1)"""
_AMP = "A AS (SELECT unit_id, amplitude AS v FROM S WHERE amplitude IS NOT NULL AND NOT isnan(amplitude))"

SQL = {
    "shifted_coincidences": f"WITH {_LAGS} SELECT a, b, lag, n, round(frac_a, 6) AS frac_a, round(frac_b, 6) AS frac_b FROM SC",
    "redundancy_search": f"""WITH RECURSIVE {_U}, {components_sql(_NEAR3)}, {_BLOCK_LAGS}, {_PEAK}, SH AS (SELECT T.unit_id, sensor_row, sensor_col, T.lag - PK.lag AS lag, v FROM T JOIN PK USING (unit_id)),
        CO AS (SELECT a, b FROM SC JOIN SH x ON x.unit_id = a JOIN SH y ON y.unit_id = b AND y.sensor_row = x.sensor_row AND y.sensor_col = x.sensor_col AND y.lag = x.lag
               WHERE frac_a >= 0.5 AND frac_b >= 0.5 GROUP BY a, b HAVING sum(x.v * y.v) / sqrt(sum(x.v * x.v) * sum(y.v * y.v)) >= 0.5),
        BW2 AS (SELECT a, b FROM CO UNION SELECT b, a FROM CO), R2 AS (SELECT DISTINCT unit_id AS a, unit_id AS b FROM units UNION SELECT R2.a, BW2.b FROM R2 JOIN BW2 ON R2.b = BW2.a),
        G AS (SELECT a AS unit_id, min(b) AS component FROM R2 GROUP BY a),
        Z AS (SELECT unit_id, G.component, separability, count(*) OVER w AS n, max(CASE WHEN NOT isnan(separability) THEN separability END) OVER w AS m FROM G JOIN U USING (unit_id) WINDOW w AS (PARTITION BY G.component))
        SELECT unit_id, component, n = 1 OR coalesce(separability = m, false) AS keep FROM Z""",
    "winner_quality": f"""WITH {_SNIP}, K AS (SELECT W.channel, W.spike, W.v, sigma, least(floor(-W.v / sigma), 6)::INT AS component FROM W JOIN SIG USING (channel) WHERE lag = 0),
        WF AS (SELECT channel, component, lag, avg(W.v) AS m FROM W JOIN K USING (channel, spike) GROUP BY ALL), SCO AS (SELECT channel, component, sqrt(sum(m * m)) AS score FROM WF GROUP BY ALL),
        ST AS (SELECT channel, component, avg(abs(v)) AS m, coalesce(stddev_samp(v), 0) AS s, any_value(score) AS score FROM K JOIN SCO USING (channel, component) GROUP BY ALL),
        RK AS (SELECT *, row_number() OVER w AS rank, lead(m) OVER w AS below FROM ST WINDOW w AS (PARTITION BY channel ORDER BY score DESC, component)),
        MG AS (SELECT *, max(CASE WHEN rank = 1 AND below IS NOT NULL AND (s / m <= 0.05 OR m <= below) THEN 1 ELSE 0 END) OVER (PARTITION BY channel) AS merged FROM RK),
        RO AS (SELECT channel, component, CASE WHEN rank <= 1 + merged THEN 'winner' WHEN rank = 2 + merged THEN 'nearest' ELSE 'other' END AS role FROM MG),
        F AS (SELECT channel, count(*) FILTER (role = 'winner') AS n, avg(abs(v)) FILTER (role = 'winner') AS mean_amp, coalesce(stddev_samp(v) FILTER (role = 'winner'), 0) AS amplitude_sd,
            coalesce(avg(abs(v)) FILTER (role = 'nearest'), 0) AS near, any_value(sigma) AS sigma, count(DISTINCT component) FILTER (role <> 'winner') + 1 AS components FROM K JOIN RO USING (channel, component) GROUP BY channel)
        SELECT channel, n, round(mean_amp, 6) AS mean_amp, round(amplitude_sd, 6) AS amplitude_sd, round(amplitude_sd / mean_amp, 6) AS rstd, round((mean_amp - near) / sigma, 6) AS separability, components FROM F""",
    "trace_snr": f"WITH {_SNIP}, A AS (SELECT channel, lag, avg(v) AS v FROM W GROUP BY channel, lag) SELECT channel, round(max(abs(v)) / any_value(sigma), 6) AS snr FROM A JOIN SIG USING (channel) GROUP BY channel",
    "rethreshold": f"""WITH {_S}, {_U}, {_AMP}, C AS (SELECT unit_id, count(*) FILTER (v <= -4 * noise_std) AS n, avg(abs(v)) FILTER (v <= -4 * noise_std) AS mean_amp,
            coalesce(stddev_samp(v) FILTER (v <= -4 * noise_std), 0) AS sd, coalesce(avg(abs(v)) FILTER (v > -4 * noise_std), 0) AS other, any_value(noise_std) AS noise_std FROM A JOIN U USING (unit_id) GROUP BY unit_id)
        SELECT unit_id, n, round(mean_amp, 9) AS mean_amp, round(sd, 9) AS amplitude_sd, round(sd / mean_amp, 9) AS rstd, round((mean_amp - other) / noise_std, 9) AS separability FROM C WHERE n > 0""",
    "backfilled_units": f"""WITH {_S}, {_U}, {_AMP}, M AS (SELECT unit_id, avg(v) AS m FROM A GROUP BY 1),
        C AS (SELECT unit_id, avg(pow(v - m, 3)) / nullif(pow(avg(pow(v - m, 2)), 1.5), 0) AS skewn, avg(pow(v - m, 4)) / nullif(pow(avg(pow(v - m, 2)), 2), 0) AS kurt, coalesce(stddev_samp(v), 0) / avg(abs(v)) AS rstd,
            avg(abs(v)) / nullif(coalesce(stddev_samp(v), 0), 0) AS iso FROM A JOIN M USING (unit_id) GROUP BY unit_id)
        SELECT unit_id, round(coalesce(CASE WHEN NOT isnan(U.skewn) THEN U.skewn END, C.skewn, U.skewn), 6) AS skewn, round(coalesce(CASE WHEN NOT isnan(U.kurt) THEN U.kurt END, C.kurt, U.kurt), 6) AS kurt,
            round(coalesce(CASE WHEN NOT isnan(U.rstd) THEN U.rstd END, C.rstd, U.rstd), 6) AS rstd, round(coalesce(CASE WHEN NOT isnan(U.iso_i_nn) THEN U.iso_i_nn END, C.iso, U.iso_i_nn), 6) AS iso_i_nn FROM U LEFT JOIN C USING (unit_id)""",
    "units_by_feature": f"WITH {_U} SELECT roi_id, unit_id, row_number() OVER (PARTITION BY roi_id ORDER BY iso_i_nn DESC NULLS LAST, unit_id)::INT AS rank FROM U",
    "lag_product_pairs": f"""WITH {_T}, {RELATION_SQL["best_lag"].split("PR AS")[0].split("WITH")[1].strip().rstrip(",")}, PR AS (SELECT DISTINCT least(unit_a, unit_b) AS a, greatest(unit_a, unit_b) AS b FROM unit_pairs WHERE unit_a <> unit_b)
        SELECT a, b, x.lag + y.lag AS lag, round(sum(x.v * y.v), 6) AS v FROM PR JOIN T x ON x.unit_id = a JOIN T y ON y.unit_id = b AND y.sensor_row = x.sensor_row AND y.sensor_col = x.sensor_col GROUP BY a, b, x.lag + y.lag""",
    "largest_block": f"WITH {RELATION_SQL['block_sizes'].split('WITH', 1)[1].rsplit('SELECT component, count(*)', 1)[0].rstrip()}, BS AS (SELECT component, count(*) AS units FROM CC GROUP BY 1) SELECT * FROM BS ORDER BY units DESC, component LIMIT 1",
    "kde_order": f"""WITH {_S}, {_U}, X AS (SELECT roi_id, x, row_number() OVER (PARTITION BY roi_id ORDER BY x DESC) AS i FROM (SELECT unit_id, avg(amplitude * amplitude) AS x FROM S WHERE amplitude IS NOT NULL AND NOT isnan(amplitude) GROUP BY 1) JOIN U USING (unit_id)),
        EN AS (SELECT roi_id, min(x) AS least, max(x) AS top, count(*) AS n, 1.06 * coalesce(stddev_samp(x), 0) * pow(count(*), -0.2) AS width FROM X GROUP BY 1),
        D AS (SELECT roi_id, pt, any_value(least + (top - least) * pt / 255) AS p, round(sum(exp(-0.5 * ((x - (least + (top - least) * pt / 255)) / nullif(width, 0)) ** 2)), 9) AS d FROM X JOIN EN USING (roi_id) CROSS JOIN (SELECT unnest(range(0, 256)) AS pt) GROUP BY ALL),
        MO AS (SELECT roi_id, p AS mode FROM D QUALIFY row_number() OVER (PARTITION BY roi_id ORDER BY coalesce(d, 0) DESC, pt) = 1)
        SELECT roi_id, round(mode, 6) AS mode, (CASE WHEN mode <= least THEN any_value(n) ELSE min(CASE WHEN x < 2 * mode - least THEN i END) END)::INT AS by_kde FROM X JOIN MO USING (roi_id) JOIN EN USING (roi_id) GROUP BY roi_id, mode, least""",
    "dense_counts": f"""WITH {_ONCE}, {_ACT}, BX AS (SELECT min(boss_row) AS r0, max(boss_row) AS r1, min(boss_column) AS c0, max(boss_column) AS c1 FROM ACT),
        GR AS (SELECT unnest(range(r0, r1 + 1))::INT AS boss_row, c0, c1 FROM BX), GC AS (SELECT boss_row, unnest(range(c0, c1 + 1))::INT AS boss_column FROM GR)
        SELECT boss_row, boss_column, coalesce(n, 0) AS n FROM GC LEFT JOIN ACT USING (boss_row, boss_column)""",
    "region_times": f"WITH {_ONCE}, {_ACT} SELECT DISTINCT boss_row, boss_column, time FROM B JOIN ACT USING (boss_row, boss_column) WHERE n >= 20 AND time IS NOT NULL",
    "filled_regions": f"WITH {_REG} SELECT DISTINCT roi_row, roi_col, row, unnest([col, col + 1]) AS col FROM REG",
    "frame_mask": f"WITH {_REG}, {_MASK} SELECT frame FROM MASK",
    "masked_spikes": f"""WITH {_REG}, {_MASK}, G AS (SELECT DISTINCT gt_id, sensor_row AS row, sensor_col AS col, round(time * {RATE})::BIGINT AS frame FROM true_spikes WHERE time IS NOT NULL AND NOT isnan(time))
        SELECT gt_id, frame FROM G SEMI JOIN REG USING (row, col) SEMI JOIN MASK USING (frame)""",
    "data_positions": f"""WITH {_ONCE}, K AS (SELECT event_id, boss_row, boss_column FROM B WHERE boss_row IS NOT NULL AND boss_column IS NOT NULL), PR AS (SELECT boss_row, row_number() OVER (ORDER BY boss_row)::INT AS row_at FROM (SELECT DISTINCT boss_row FROM K)),
        PC AS (SELECT boss_column, row_number() OVER (ORDER BY boss_column)::INT AS col_at FROM (SELECT DISTINCT boss_column FROM K)) SELECT event_id, row_at, col_at FROM K JOIN PR USING (boss_row) JOIN PC USING (boss_column)""",
    "expected_components": f"WITH {_REG} SELECT roi_row, roi_col, count(*) AS sensors, ceil(2029.0::DOUBLE * ({PITCH}::DOUBLE * {PITCH}::DOUBLE / 1e6) * count(*))::BIGINT AS expected FROM REG GROUP BY 1, 2",
    "active_frames": f"""WITH {_GRID}, C2 AS (SELECT *, v - avg(v) OVER (PARTITION BY row, col) AS c FROM G), Z AS (SELECT row, col, frame, c / (median(abs(c)) OVER (PARTITION BY row, col) / 0.6745) AS v FROM C2)
        SELECT frame, count(*) AS voxels FROM ({_BOX.format(g='Z')}) WHERE energy > 60 GROUP BY frame""",
    "equal_regions": f"""WITH {_SETS}, D AS (SELECT filename || '#' || roi AS region, list_sort(list(DISTINCT pixel)) AS l FROM ST WHERE filename IS NOT NULL GROUP BY filename, roi)
        SELECT region, min(region) OVER (PARTITION BY l) AS class, len(l)::BIGINT AS n FROM D""",
    "event_list": "SELECT coalesce(boss_column, -1) AS boss_column, coalesce(boss_row, -1) AS boss_row, count(*) AS n, count(nullif(sensors, '')) AS packed, max(time) AS last FROM basic_events GROUP BY 1, 2",
    "trace_box": f"WITH {_GRID} SELECT row, col, frame, v FROM G WHERE row BETWEEN 3 AND 7 AND col BETWEEN 2 AND 20 AND frame BETWEEN 5 AND 40",
    "recording_facts": f"""WITH {_ONCE} SELECT filename AS rec_id, count(time) AS frames, round(count(time) / (max(time) - min(time)), 6) AS sr_khz, count(DISTINCT boss_row)::INT AS rows, count(DISTINCT boss_column)::INT AS cols, {PITCH}::DOUBLE AS pitch
        FROM B WHERE filename IS NOT NULL AND time IS NOT NULL GROUP BY filename""",
    "least_peaks": f"WITH {_ONCE} SELECT filename, round((max(time) - min(time)) * {S.least_peaks(1e-3, RATE, 3.0)!r}::DOUBLE, 6) AS least FROM B GROUP BY filename",
}
