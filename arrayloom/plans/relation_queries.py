"""Queries of the relational operators: events, regions of interest, units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arrayloom.operators import events as E
from arrayloom.operators import joins as J
from arrayloom.operators import units as U
from arrayloom.operators.components import connected_components, single_linkage
from arrayloom.operators.order import order_estimates
from arrayloom.operators.packed import count_packed, split_packed
from arrayloom.plans.array_queries import SQL as ARRAY_SQL
from arrayloom.plans.array_queries import p4_found
from arrayloom.session import write_through
from arrayloom.sources.tables import table

ROWS = 128


def _once(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    return table(spark, folder, "basic_events").select("event_id", "boss_row", "boss_column", "time", *extra).distinct()


def _units(spark: SparkSession, folder: str) -> DataFrame:
    """Each unit once; fields of repeated rows are the same but for NaN, which a comparison can't see."""
    return table(spark, folder, "units").drop("status").dropDuplicates(["unit_id"])


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    pairs = table(spark, folder, "unit_pairs").filter("unit_a <> unit_b")
    return pairs.select(F.least("unit_a", "unit_b").alias("a"), F.greatest("unit_a", "unit_b").alias("b")).distinct()


def _templates(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "unit_templates")


def _took_part(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    """The sensors of each event with its boss sensor, from one reading of the events."""
    carry = ("boss_row", "boss_column", *extra)
    return split_packed(table(spark, folder, "basic_events"), "event_id", "sensors", ["filename", "place"], ("sensor_col", "sensor_row"), carry)


def event_validity(spark, folder):
    """Events with at most four sensors."""
    counted = count_packed(table(spark, folder, "basic_events"), "event_id", "sensors", ["filename", "place"])
    return E.valid_events(counted.withColumnRenamed("values", "sensors"), 4)


def _sets(spark: SparkSession, folder: str, *by: str) -> DataFrame:
    """Sensors by boss sensor (and the fields `by` of its events), both as linear indices."""
    known = _took_part(spark, folder, *by).filter("boss_row IS NOT NULL AND boss_column IS NOT NULL")
    roi, pixel = E.linear_index(F.col("boss_row"), F.col("boss_column"), ROWS), E.linear_index(F.col("sensor_row"), F.col("sensor_col"), ROWS)
    return known.select(*by, roi.alias("roi"), pixel.alias("pixel")).distinct()


def _regions(spark: SparkSession, folder: str, fill: bool = False) -> DataFrame:
    active = E.active_sensors(_once(spark, folder), "boss_row", "boss_column", 20)
    return E.regions(_took_part(spark, folder), active, fill)


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def asof_event(spark, folder):
    """For each true spike the last event detected at its sensor before or at its time."""
    refs = _once(spark, folder).select(F.col("boss_row").alias("sensor_row"), F.col("boss_column").alias("sensor_col"), F.col("time").alias("at"), "event_id")
    probes = table(spark, folder, "true_spikes").select("gt_id", "sensor_row", "sensor_col", "time").filter("time IS NOT NULL AND NOT isnan(time)").distinct()
    return J.asof_backward(probes, refs, ["sensor_row", "sensor_col"], "time", "at", "event_id", 2000.0).select("gt_id", "event_id")


def box_scan(spark, folder):
    return _once(spark, folder).filter("boss_row BETWEEN 20 AND 60 AND boss_column BETWEEN 10 AND 50 AND time BETWEEN 100 AND 20000")


def file_rate(spark, folder):
    """Events per millisecond and the least number of events of each file, from its duration."""
    out = _once(spark, folder, "filename").groupBy("filename").agg(F.count("*").alias("n"), (F.max("time") - F.min("time")).alias("span"))
    return out.select("filename", "n", F.round(F.try_divide("n", "span"), 6).alias("rate"), F.round(3 * F.col("span") / 1000, 6).alias("least_events"))


def roi_boxes(spark, folder):
    return E.drop_degenerate(_regions(spark, folder), ["roi_row", "roi_col"])


def spikes_in_regions(spark, folder):
    """True spikes whose sensor takes part in a region, with the number of such regions."""
    spikes = table(spark, folder, "true_spikes").select("gt_id", "sensor_row", "sensor_col").distinct()
    roi = write_through(_regions(spark, folder))
    boxed = J.in_boxes(spikes, "sensor_row", "sensor_col", E.drop_degenerate(roi, ["roi_row", "roi_col"]))
    member = roi.select("roi_row", "roi_col", F.col("row").alias("sensor_row"), F.col("col").alias("sensor_col"))
    return boxed.join(member, ["roi_row", "roi_col", "sensor_row", "sensor_col"], "left_semi").groupBy("gt_id").agg(F.count("*").alias("regions"))


def neighbourhood(spark, folder):
    """Sensors with events within two rows and columns of each unit's boss sensor."""
    boxes = _units(spark, folder).select("unit_id", (F.col("boss_row") - 2).alias("r0"), (F.col("boss_row") + 2).alias("r1"), (F.col("boss_col") - 2).alias("c0"), (F.col("boss_col") + 2).alias("c1"))
    active = E.active_sensors(_once(spark, folder), "boss_row", "boss_column", 1)
    return J.in_boxes(active, "boss_row", "boss_column", boxes).select("unit_id", "boss_row", "boss_column", "n")


def run_sets(spark, folder):
    """Active sensors of every two runs (files): in both, in the first only, in either."""
    out = J.list_parts(_once(spark, folder, "filename"), "filename", ["boss_row", "boss_column"])
    return out.withColumnsRenamed({"group_a": "file_a", "group_b": "file_b"})


def roi_overlap_two_lists(spark, folder):
    """Overlaps of the regions of one run (file) with those of another, for every two runs."""
    out = J.list_overlap(_sets(spark, folder, "filename"), "filename", "roi", "pixel")
    return _round(out.withColumnsRenamed({"group_a": "file_a", "group_b": "file_b"}), "overlap")


def snr(spark, folder):
    peak = U.boss_sensors(_templates(spark, folder))
    return _round(peak.join(_units(spark, folder).select("unit_id", "noise_std"), "unit_id").select("unit_id", F.try_divide(F.abs("extremum"), F.col("noise_std")).alias("snr")), "snr")


def amplitude_quality(spark, folder):
    out = U.amplitude_quality(table(spark, folder, "unit_spikes"), _units(spark, folder).select("unit_id", "noise_std"))
    return out.drop("noise_std").withColumns({c: F.round(c, 9) for c in ("mean_amp", "amplitude_sd", "rstd", "separability")})


def mixture_filter(spark, folder):
    """Units of small relative amplitude spread; neither null nor NaN passes."""
    return _units(spark, folder).filter("rstd IS NOT NULL AND NOT isnan(rstd) AND rstd <= 0.15").select("unit_id", "rstd")


def best_units(spark, folder):
    """The three most separable units of each region."""
    line = Window.partitionBy("roi_id").orderBy(F.desc("separability"), "unit_id")
    return _units(spark, folder).withColumn("rank", F.row_number().over(line)).filter("rank <= 3").select("roi_id", "unit_id", "rank")


def redundant_units(spark, folder):
    """Groups of units with mutual coincidence and similarity, and which unit of each is kept."""
    p = table(spark, folder, "unit_pairs").filter("unit_a <> unit_b AND least(coin_ab, coin_ba) >= 0.5 AND NOT isnan(sim)")
    groups = single_linkage(p, "unit_a", "unit_b", "sim", 0.5, _units(spark, folder), "unit_id")
    units = _units(spark, folder).select("unit_id", "separability").join(groups, "unit_id")
    return U.keep_best(units, "component", "separability").select("unit_id", "component", "keep")


def spatial_blocks(spark, folder):
    """Units linked through steps of at most 1.5 sensors: blocks inside which redundancy is looked for."""
    units = _units(spark, folder)
    near = J.pairs_within(units, "unit_id", "boss_row", "boss_col", 1.5)
    return connected_components(near, "a", "b", units, "unit_id")


def block_sizes(spark, folder):
    return spatial_blocks(spark, folder).groupBy("component").agg(F.count("*").alias("units"))


def result_events(spark, folder):
    """The event list of the result: each spike with the running number of its unit."""
    units = U.numbered(_units(spark, folder).select("unit_id", "roi_id", "k", "boss_row", "boss_col"), ["roi_id", "k", "unit_id"], "place")
    spikes = table(spark, folder, "unit_spikes").select("spike_id", "unit_id", "time", "amplitude").filter("time IS NOT NULL").distinct()
    return spikes.join(units, "unit_id").select("spike_id", "place", "time", "amplitude", F.col("boss_col").alias("boss_column"), "boss_row")


def order_rules(spark, folder):
    """Order estimates over the spectra that the units' spike amplitudes give per region."""
    spikes = table(spark, folder, "unit_spikes").filter("amplitude IS NOT NULL AND NOT isnan(amplitude)").select("spike_id", "unit_id", "amplitude").distinct()
    power = spikes.groupBy("unit_id").agg(F.avg(F.col("amplitude") ** 2).alias("x"))
    return order_estimates(power.join(_units(spark, folder).select("unit_id", "roi_id"), "unit_id"), ["roi_id"], "x", 1000.0)


def lag_product(spark, folder):
    """Cauchy product over the lags of each unit's template with itself, summed over sensors."""
    t = _templates(spark, folder).filter("v IS NOT NULL AND NOT isnan(v)").select("unit_id", "sensor_row", "sensor_col", "lag", "v").distinct()
    other = t.select("unit_id", "sensor_row", "sensor_col", F.col("lag").alias("lag2"), F.col("v").alias("v2"))
    both = t.join(other, ["unit_id", "sensor_row", "sensor_col"])
    return both.groupBy("unit_id", (F.col("lag") + F.col("lag2")).alias("lag")).agg(F.round(F.sum(F.col("v") * F.col("v2")), 6).alias("v"))


def event_coincidences(spark, folder):
    """True spikes with exactly one event of their sensor within ten milliseconds, and that event."""
    spikes = table(spark, folder, "true_spikes").select("gt_id", F.col("sensor_row").alias("boss_row"), F.col("sensor_col").alias("boss_column"), F.col("time").alias("t")).filter("t IS NOT NULL AND NOT isnan(t)").distinct()
    return J.coincidences(spikes, _once(spark, folder), ["boss_row", "boss_column"], "t", "time", 10.0, "gt_id").select("gt_id", "event_id")


def sensor_index(spark, folder):
    places = p4_found(spark, folder).select("sensor_row", "sensor_col").distinct()
    i = places.withColumn("i", E.linear_index(F.col("sensor_row"), F.col("sensor_col"), ROWS))
    row, col = E.from_linear(F.col("i"), ROWS)
    return i.select("i", row.cast("int").alias("sensor_row"), col.cast("int").alias("sensor_col"))


QUERIES = {
    "asof_event": asof_event,
    "box_scan": box_scan,
    "file_rate": file_rate,
    "event_validity": event_validity,
    "active_sensors": lambda s, d: E.active_sensors(_once(s, d), "boss_row", "boss_column", 20),
    "region_sensors": _regions,
    "roi_boxes": roi_boxes,
    "roi_overlap_self": lambda s, d: _round(J.set_overlap(_sets(s, d), "roi", "pixel"), "overlap"),
    "roi_overlap_two_lists": roi_overlap_two_lists,
    "run_sets": run_sets,
    "pairs_within": lambda s, d: _round(J.pairs_within(_units(s, d), "unit_id", "boss_row", "boss_col", 3.0), "distance"),
    "spikes_in_regions": spikes_in_regions,
    "neighbourhood": neighbourhood,
    "sensor_index": sensor_index,
    "boss_sensor": lambda s, d: U.boss_sensors(_templates(s, d)),
    "snr": snr,
    "amplitude_quality": amplitude_quality,
    "mixture_filter": mixture_filter,
    "feature_range": lambda s, d: U.select_by_range(_units(s, d), "iso_i_nn", 3.0, 9.0).select("unit_id"),
    "best_units": best_units,
    "template_similarity": lambda s, d: _round(U.template_similarity(_templates(s, d), _pairs(s, d)), "cosine"),
    "best_lag": lambda s, d: U.best_lag(table(s, d, "unit_spikes"), _pairs(s, d), 0.25, 4),
    "coin_fraction": lambda s, d: _round(U.coincidence_fractions(table(s, d, "unit_spikes"), _pairs(s, d), 1.0), "frac_a", "frac_b"),
    "event_coincidences": event_coincidences,
    "redundant_units": redundant_units,
    "spatial_blocks": spatial_blocks,
    "block_sizes": block_sizes,
    "first_places": lambda s, d: U.first_places(table(s, d, "true_spikes"), "neuron", "gt_id"),
    "result_events": result_events,
    "order_rules": order_rules,
    "lag_product": lag_product,
    "bin_trains": lambda s, d: table(s, d, "unit_spikes").filter("time IS NOT NULL AND NOT isnan(time)").select("spike_id", "unit_id", F.floor(F.col("time") / 5).alias("bin")).distinct().groupBy("unit_id", "bin").agg(F.count("*").alias("n")),
    "ms_frames": lambda s, d: _once(s, d).select("event_id", F.round(F.col("time") * 11.7).cast("long").alias("frame")),
}

_P4 = "P4 AS (" + ARRAY_SQL["p4_found"] + ")"
_ONCE = "B AS (SELECT DISTINCT event_id, boss_row, boss_column, time, filename FROM basic_events)"
_U = "U AS (SELECT * FROM units QUALIFY row_number() OVER (PARTITION BY unit_id) = 1)"
_S = "S AS (SELECT DISTINCT spike_id, unit_id, time, amplitude FROM unit_spikes)"
_PAIRS = "PR AS (SELECT DISTINCT least(unit_a, unit_b) AS a, greatest(unit_a, unit_b) AS b FROM unit_pairs WHERE unit_a <> unit_b)"
_T = "T AS (SELECT DISTINCT * FROM unit_templates WHERE v IS NOT NULL AND NOT isnan(v))"
_ACT = "ACT AS (SELECT boss_row, boss_column, count(*) AS n FROM B WHERE boss_row IS NOT NULL AND boss_column IS NOT NULL GROUP BY ALL)"
_REG = f"""{_ONCE}, {_ACT}, {_P4}, A20 AS (SELECT * FROM ACT WHERE n >= 20),
    REG AS (SELECT B.boss_row AS roi_row, B.boss_column AS roi_col, sensor_row AS row, sensor_col AS col FROM B JOIN A20 USING (boss_row, boss_column) JOIN P4 USING (event_id)
            UNION SELECT boss_row, boss_column, boss_row, boss_column FROM A20),
    BOX AS (SELECT roi_row, roi_col, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1, count(*) AS sensors FROM REG GROUP BY ALL HAVING r0 < r1 AND c0 < c1)"""
_SETS = f"""{_ONCE}, {_P4}, ST AS (SELECT DISTINCT filename, (boss_column - 1) * 128 + boss_row AS roi, (sensor_col - 1) * 128 + sensor_row AS pixel
    FROM B JOIN P4 USING (event_id) WHERE boss_row IS NOT NULL AND boss_column IS NOT NULL)"""
_PEAK = f"{_T}, PK AS (SELECT unit_id, sensor_row AS boss_row, sensor_col AS boss_col, lag, v AS extremum FROM T QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY abs(v) DESC, sensor_col, sensor_row, lag) = 1)"
_FRAC = f"""{_S}, {_PAIRS}, V AS (SELECT * FROM S WHERE time IS NOT NULL AND NOT isnan(time)), N AS (SELECT unit_id, count(*) AS n FROM V GROUP BY 1),
    M AS (SELECT a, b, x.spike_id FROM PR JOIN V x ON x.unit_id = a JOIN V y ON y.unit_id = b AND abs(x.time - y.time) <= 1 GROUP BY ALL HAVING count(*) = 1)"""


def _components(edges: str) -> str:
    return f"""E AS ({edges}), BW AS (SELECT a, b FROM E UNION SELECT b, a FROM E),
        R AS (SELECT DISTINCT unit_id AS a, unit_id AS b FROM units UNION SELECT R.a, BW.b FROM R JOIN BW ON R.b = BW.a),
        CC AS (SELECT a AS unit_id, min(b) AS component FROM R GROUP BY a)"""


_NEAR = "SELECT x.unit_id AS a, y.unit_id AS b FROM U x JOIN U y ON x.unit_id < y.unit_id AND (x.boss_row - y.boss_row) ** 2 + (x.boss_col - y.boss_col) ** 2 <= 2.25"

SQL = {
    "asof_event": f"""WITH {_ONCE}, R AS (SELECT boss_row, boss_column, time, max(event_id) AS event_id FROM B WHERE time IS NOT NULL GROUP BY ALL),
        L AS (SELECT DISTINCT gt_id, sensor_row, sensor_col, time FROM true_spikes WHERE time IS NOT NULL AND NOT isnan(time))
        SELECT gt_id, event_id FROM L ASOF LEFT JOIN R ON L.sensor_row = R.boss_row AND L.sensor_col = R.boss_column AND L.time >= R.time""",
    "box_scan": f"WITH {_ONCE} SELECT event_id, boss_row, boss_column, time FROM B WHERE boss_row BETWEEN 20 AND 60 AND boss_column BETWEEN 10 AND 50 AND time BETWEEN 100 AND 20000",
    "file_rate": f"WITH {_ONCE} SELECT filename, count(*) AS n, round(count(*) / (max(time) - min(time)), 6) AS rate, round(3 * (max(time) - min(time)) / 1000, 6) AS least_events FROM B GROUP BY filename",
    "event_validity": f"WITH {_P4} SELECT event_id, count(*) AS sensors FROM P4 GROUP BY 1 HAVING count(*) <= 4",
    "active_sensors": f"WITH {_ONCE}, {_ACT} SELECT * FROM ACT WHERE n >= 20",
    "region_sensors": f"WITH {_REG} SELECT * FROM REG",
    "roi_boxes": f"WITH {_REG} SELECT * FROM BOX",
    "roi_overlap_self": f"""WITH {_SETS}, D AS (SELECT DISTINCT roi, pixel FROM ST), N AS (SELECT roi, count(*) AS n FROM D GROUP BY 1)
        SELECT x.roi AS a, y.roi AS b, count(*) AS common, round(count(*) / least(any_value(p.n), any_value(q.n)), 6) AS overlap
        FROM D x JOIN D y ON x.pixel = y.pixel AND x.roi < y.roi JOIN N p ON p.roi = x.roi JOIN N q ON q.roi = y.roi GROUP BY x.roi, y.roi""",
    "roi_overlap_two_lists": f"""WITH {_SETS}, D AS (SELECT * FROM ST WHERE filename IS NOT NULL), N AS (SELECT filename, roi, count(*) AS n FROM D GROUP BY 1, 2)
        SELECT x.filename AS file_a, x.roi AS a, y.filename AS file_b, y.roi AS b, count(*) AS common, round(count(*) / least(any_value(p.n), any_value(q.n)), 6) AS overlap
        FROM D x JOIN D y ON x.pixel = y.pixel AND x.filename < y.filename JOIN N p ON p.filename = x.filename AND p.roi = x.roi
        JOIN N q ON q.filename = y.filename AND q.roi = y.roi GROUP BY x.filename, x.roi, y.filename, y.roi""",
    "run_sets": f"""WITH {_ONCE}, P AS (SELECT DISTINCT filename, boss_row, boss_column FROM B WHERE filename IS NOT NULL AND boss_row IS NOT NULL AND boss_column IS NOT NULL),
        N AS (SELECT filename, count(*) AS n FROM P GROUP BY 1),
        C AS (SELECT x.filename AS a, y.filename AS b, count(*) AS n FROM P x JOIN P y USING (boss_row, boss_column) WHERE x.filename < y.filename GROUP BY 1, 2),
        S AS (SELECT x.filename AS file_a, y.filename AS file_b, x.n AS na, y.n AS nb, coalesce(C.n, 0) AS common FROM N x JOIN N y ON x.filename < y.filename LEFT JOIN C ON a = x.filename AND b = y.filename)
        SELECT file_a, file_b, 'both' AS part, common AS n FROM S UNION ALL SELECT file_a, file_b, 'first_only', na - common FROM S
        UNION ALL SELECT file_a, file_b, 'either', na + nb - common FROM S""",
    "pairs_within": f"""WITH {_U} SELECT x.unit_id AS a, y.unit_id AS b, round(sqrt((x.boss_row - y.boss_row) ** 2 + (x.boss_col - y.boss_col) ** 2), 6) AS distance
        FROM U x JOIN U y ON x.unit_id < y.unit_id AND (x.boss_row - y.boss_row) ** 2 + (x.boss_col - y.boss_col) ** 2 <= 9""",
    "spikes_in_regions": f"""WITH {_REG}, G AS (SELECT DISTINCT gt_id, sensor_row, sensor_col FROM true_spikes)
        SELECT gt_id, count(*) AS regions FROM G JOIN REG ON row = sensor_row AND col = sensor_col JOIN BOX USING (roi_row, roi_col) GROUP BY gt_id""",
    "neighbourhood": f"WITH {_ONCE}, {_ACT}, {_U} SELECT unit_id, ACT.boss_row, boss_column, n FROM U JOIN ACT ON abs(ACT.boss_row - U.boss_row) <= 2 AND abs(boss_column - boss_col) <= 2",
    "sensor_index": f"WITH {_P4} SELECT DISTINCT (sensor_col - 1) * 128 + sensor_row AS i, sensor_row, sensor_col FROM P4",
    "boss_sensor": f"WITH {_PEAK} SELECT * FROM PK",
    "snr": f"WITH {_PEAK}, {_U} SELECT unit_id, round(abs(extremum) / nullif(noise_std, 0), 6) AS snr FROM PK JOIN U USING (unit_id)",
    "amplitude_quality": f"""WITH {_S}, {_U}, A AS (SELECT unit_id, count(*) AS n, avg(abs(amplitude)) AS mean_amp, coalesce(stddev_samp(amplitude), 0) AS amplitude_sd, min(amplitude) AS least, max(amplitude) AS greatest
            FROM S WHERE amplitude IS NOT NULL AND NOT isnan(amplitude) GROUP BY 1)
        SELECT unit_id, n, round(mean_amp, 9) AS mean_amp, round(A.amplitude_sd, 9) AS amplitude_sd, least, greatest, round(A.amplitude_sd / nullif(mean_amp, 0), 9) AS rstd,
            round(mean_amp / nullif(noise_std, 0), 9) AS separability FROM A JOIN U USING (unit_id)""",
    "mixture_filter": f"WITH {_U} SELECT unit_id, rstd FROM U WHERE rstd <= 0.15 AND NOT isnan(rstd)",
    "feature_range": f"WITH {_U} SELECT unit_id FROM U WHERE isnan(iso_i_nn) OR iso_i_nn BETWEEN 3 AND 9",
    "best_units": f"WITH {_U} SELECT roi_id, unit_id, row_number() OVER (PARTITION BY roi_id ORDER BY separability DESC, unit_id)::INT AS rank FROM U QUALIFY rank <= 3",
    "template_similarity": f"""WITH {_PEAK}, {_PAIRS}, SH AS (SELECT T.unit_id, sensor_row, sensor_col, T.lag - PK.lag AS lag, v FROM T JOIN PK USING (unit_id))
        SELECT a, b, round(sum(x.v * y.v) / sqrt(sum(x.v * x.v) * sum(y.v * y.v)), 6) AS cosine FROM PR JOIN SH x ON x.unit_id = a
        JOIN SH y ON y.unit_id = b AND y.sensor_row = x.sensor_row AND y.sensor_col = x.sensor_col AND y.lag = x.lag GROUP BY a, b""",
    "best_lag": f"""WITH {_S}, {_PAIRS}, C AS (SELECT unit_id, floor(time / 0.25)::BIGINT AS bin, count(*) AS n FROM S WHERE time IS NOT NULL AND NOT isnan(time) GROUP BY ALL),
        L AS (SELECT a, b, (x.bin - y.bin)::INT AS lag, sum(x.n * y.n)::BIGINT AS n FROM PR JOIN C x ON x.unit_id = a JOIN C y ON y.unit_id = b AND y.bin BETWEEN x.bin - 4 AND x.bin + 4 GROUP BY ALL)
        SELECT * FROM L QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY n DESC, lag) = 1""",
    "coin_fraction": f"""WITH {_FRAC} SELECT a, b, count(*) AS n, round(count(*) / any_value(p.n), 6) AS frac_a, round(count(*) / any_value(q.n), 6) AS frac_b
        FROM M JOIN N p ON p.unit_id = a JOIN N q ON q.unit_id = b GROUP BY a, b""",
    "event_coincidences": f"""WITH {_ONCE}, G AS (SELECT DISTINCT gt_id, sensor_row, sensor_col, time AS t FROM true_spikes WHERE time IS NOT NULL AND NOT isnan(time))
        SELECT gt_id, min(event_id) AS event_id FROM G JOIN B ON boss_row = sensor_row AND boss_column = sensor_col AND B.time BETWEEN t - 11 AND t + 11
        WHERE abs(t - B.time) <= 10 GROUP BY gt_id HAVING count(*) = 1""",
    "redundant_units": f"""WITH RECURSIVE {_U}, {_components("SELECT unit_a AS a, unit_b AS b FROM unit_pairs WHERE least(coin_ab, coin_ba) >= 0.5 AND sim >= 0.5 AND NOT isnan(sim)")},
        Z AS (SELECT unit_id, component, separability, count(*) OVER w AS n, max(CASE WHEN NOT isnan(separability) THEN separability END) OVER w AS m FROM CC JOIN U USING (unit_id) WINDOW w AS (PARTITION BY component))
        SELECT unit_id, component, n = 1 OR coalesce(separability = m, false) AS keep FROM Z""",
    "spatial_blocks": f"WITH RECURSIVE {_U}, {_components(_NEAR)} SELECT * FROM CC",
    "block_sizes": f"WITH RECURSIVE {_U}, {_components(_NEAR)} SELECT component, count(*) AS units FROM CC GROUP BY 1",
    "first_places": r"""SELECT neuron, arg_min(sensor_row, gt_id) AS sensor_row, arg_min(sensor_col, gt_id) AS sensor_col, count(*) AS n
        FROM (SELECT DISTINCT gt_id, lower(regexp_replace(neuron, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS neuron, sensor_row, sensor_col FROM true_spikes WHERE neuron IS NOT NULL) GROUP BY neuron""",
    "result_events": f"""WITH {_S}, {_U}, N AS (SELECT *, row_number() OVER (ORDER BY roi_id, k, unit_id) AS place FROM U)
        SELECT spike_id, place, time, amplitude, boss_col AS boss_column, boss_row FROM S JOIN N USING (unit_id) WHERE time IS NOT NULL""",
    "order_rules": f"""WITH {_S}, {_U}, X AS (SELECT roi_id, x, row_number() OVER (PARTITION BY roi_id ORDER BY x DESC) AS i, count(*) OVER (PARTITION BY roi_id) AS n
            FROM (SELECT unit_id, avg(amplitude * amplitude) AS x FROM S WHERE amplitude IS NOT NULL AND NOT isnan(amplitude) GROUP BY 1) JOIN U USING (unit_id)),
        G AS (SELECT roi_id, median(x) AS mid, avg(x) AS mean, min(x) AS least FROM X GROUP BY 1),
        L AS (SELECT roi_id, CASE WHEN count(*) > 1 THEN regr_slope(x, i) END AS slope, CASE WHEN count(*) > 1 THEN regr_intercept(x, i) END AS at0 FROM X WHERE i >= round(n / 2) GROUP BY 1),
        R AS (SELECT roi_id, sqrt(sum((x - at0 - slope * i) ** 2)) AS norm FROM X JOIN L USING (roi_id) WHERE i >= round(n / 2) GROUP BY 1),
        I AS (SELECT *, -1000 * (n - i) * ln(exp(avg(ln(x)) OVER w) / avg(x) OVER w) AS fit, i * (2 * n - i) AS free FROM X WINDOW w AS (PARTITION BY roi_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
        SELECT roi_id, any_value(n) AS n, min(CASE WHEN x < 2 * mid - least THEN i END)::INT AS by_median, min(CASE WHEN x <= mean THEN i END)::INT AS by_mean,
            min(CASE WHEN x < at0 + slope * i + 3 * norm THEN i END)::INT AS by_line,
            arg_min(i, 2 * fit + 2 * free) FILTER (i < n)::INT AS by_aic, arg_min(i, fit + 0.5 * free * ln(1000.0)) FILTER (i < n)::INT AS by_mdl
        FROM I JOIN G USING (roi_id) LEFT JOIN L USING (roi_id) LEFT JOIN R USING (roi_id) GROUP BY roi_id""",
    "lag_product": f"""WITH {_T} SELECT x.unit_id, x.lag + y.lag AS lag, round(sum(x.v * y.v), 6) AS v FROM T x JOIN T y USING (unit_id, sensor_row, sensor_col) GROUP BY x.unit_id, x.lag + y.lag""",
    "bin_trains": f"WITH {_S} SELECT unit_id, floor(time / 5)::BIGINT AS bin, count(*) AS n FROM S WHERE time IS NOT NULL AND NOT isnan(time) GROUP BY ALL",
    "ms_frames": f"WITH {_ONCE} SELECT event_id, round(time * 11.7)::BIGINT AS frame FROM B",
}
