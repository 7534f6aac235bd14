"""Queries of the training-data operators over the recording tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayloom.llm.asof import label_key, nearest_in_time
from arrayloom.llm.bpe import encode_texts
from arrayloom.llm.components import groups
from arrayloom.llm.leakage import leaks
from arrayloom.llm.quantiles import quantiles, sketches
from arrayloom.llm.spectral import most_typical, similarity_clusters
from arrayloom.llm.stuffing import stuffed_pages
from arrayloom.operators.joins import spread_join
from arrayloom.session import write_through
from arrayloom.sources.tables import table


_ASKED = [0.1, 0.25, 0.5, 0.75, 0.9, 0.99]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    units = table(spark, folder, "units").select("unit_id", label_key(F.col("neuron")).alias("neuron"))
    units = units.filter("neuron IS NOT NULL").distinct()
    right = table(spark, folder, "unit_spikes").select("spike_id", "unit_id", "time").join(units, "unit_id")
    left = table(spark, folder, "true_spikes").select("gt_id", label_key(F.col("neuron")).alias("neuron"), "time")
    return nearest_in_time(left, right, "neuron", "time", "gt_id", "spike_id", tolerance=0.5)


def _clusters(spark: SparkSession, folder: str) -> DataFrame:
    widths = table(spark, folder, "units").select("unit_id", (2 * F.col("noise_std")).alias("width"))
    spikes = table(spark, folder, "unit_spikes")
    return similarity_clusters(spikes, "spike_id", "unit_id", "amplitude", widths, "width")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _clusters(spark, folder).select("cluster_id", "spike_id")


def p3_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Size and three most typical spikes of each cluster."""
    return most_typical(_clusters(spark, folder), "spike_id", "unit_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = table(spark, folder, "unit_pairs").filter("coin_ab >= 0.6 AND coin_ba >= 0.6 AND sim >= 0.8 AND NOT isnan(coin_ab) AND NOT isnan(coin_ba) AND NOT isnan(sim)")
    units = table(spark, folder, "units")
    found = groups(units, "unit_id", pairs, "unit_a", "unit_b")
    return found.join(units.select("unit_id").distinct(), "unit_id", "left_semi")


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "basic_events")
    return events.select("event_id", "boss_row", "boss_column", F.abs("amplitude").alias("size")).distinct()


def _amplitudes(spark: SparkSession, folder: str, q: list[float]) -> DataFrame:
    return quantiles(sketches(_sizes(spark, folder), ("boss_row", "boss_column"), F.col("size")), ("boss_row", "boss_column"), q)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    found = _amplitudes(spark, folder, [0.5, 0.9])
    return found.filter("quantiles[0] >= 90 OR quantiles[1] >= 180").select("boss_row", "boss_column")


def p6_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of |amplitude| per boss sensor, with the number of events (approximate values)."""
    return _amplitudes(spark, folder, _ASKED)


def p6_within(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the ranks of each sensor's percentiles, counted over all of its events, are within 2 % of those asked for."""
    by = ["boss_row", "boss_column"]
    asked = F.explode(F.arrays_zip(F.col("quantiles").alias("q"), F.array(*map(F.lit, _ASKED)).alias("f"))).alias("a")
    found = write_through(p6_percentiles(spark, folder)).select(*by, "n", asked).select(*by, "n", "a.f", "a.q")
    # one part in 2 ** 11 of a value is the width of its cell
    low, high = F.col("q") * (1 - 2.0**-11), F.col("q") * (1 + 2.0**-11)
    sizes = _sizes(spark, folder).filter("size IS NOT NULL AND NOT isnan(size)")
    ranks = spread_join(sizes, found, by, "event_id").groupBy(*by, "f", "n").agg(
        F.sum((F.col("size") < low).cast("long")).alias("below"), F.sum((F.col("size") <= high).cast("long")).alias("upto")
    )
    share = 0.02 * F.col("n") + 1  # a rank is a whole number
    fits = (F.col("below") <= F.col("f") * (F.col("n") - 1) + share) & (F.col("upto") >= F.col("f") * (F.col("n") - 1) - share)
    return ranks.groupBy(*by, "n").agg(F.every(fits).alias("within"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(table(spark, folder, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    found = leaks(table(spark, folder, "documents"), "doc_id", table(spark, folder, "eval_items"), "item_id")
    return found.select("doc_id", "item_id")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return stuffed_pages(table(spark, folder, "documents"), "doc_id").select("doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p3_found": p3_found,
    "p3_clusters": p3_clusters,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_percentiles": p6_percentiles,
    "p6_within": p6_within,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p9_found": p9_found,
}

_CLUSTERS = """
    WITH w AS (SELECT unit_id, 2 * max(noise_std) AS width FROM units WHERE NOT isnan(noise_std) GROUP BY unit_id),
    s AS (SELECT DISTINCT spike_id, unit_id, amplitude FROM unit_spikes WHERE amplitude IS NOT NULL AND NOT isnan(amplitude)),
    g AS (
        SELECT *, CASE WHEN amplitude - lag(amplitude) OVER o <= width THEN 0 ELSE 1 END AS gap
        FROM s JOIN w USING (unit_id) WINDOW o AS (PARTITION BY unit_id ORDER BY amplitude, spike_id)),
    c AS (SELECT *, sum(gap) OVER (PARTITION BY unit_id ORDER BY amplitude, spike_id ROWS UNBOUNDED PRECEDING) AS c FROM g),
    m AS (
        SELECT *, min(spike_id) OVER k AS cluster_id, count(*) OVER k AS size, sum(amplitude) OVER k AS s1, sum(amplitude * amplitude) OVER k AS s2
        FROM c WINDOW k AS (PARTITION BY unit_id, c))"""

SQL = {
    "p1_found": r"""
        WITH u AS (SELECT DISTINCT unit_id, lower(regexp_replace(neuron, '^\s+|\s+$', '', 'g')) AS neuron FROM units WHERE neuron IS NOT NULL),
        r AS (SELECT DISTINCT spike_id, neuron, time FROM unit_spikes JOIN u USING (unit_id) WHERE time IS NOT NULL AND NOT isnan(time)),
        l AS (SELECT DISTINCT gt_id, lower(regexp_replace(neuron, '^\s+|\s+$', '', 'g')) AS neuron, time FROM true_spikes
              WHERE neuron IS NOT NULL AND time IS NOT NULL AND NOT isnan(time))
        SELECT gt_id, spike_id FROM l JOIN r ON l.neuron = r.neuron AND r.time BETWEEN l.time - 0.6 AND l.time + 0.6
        WHERE abs(l.time - r.time) <= 0.5
        QUALIFY row_number() OVER (PARTITION BY gt_id ORDER BY abs(l.time - r.time), spike_id) = 1""",
    "p3_found": _CLUSTERS + " SELECT cluster_id, spike_id FROM m WHERE size >= 3",
    "p3_clusters": _CLUSTERS + """
        SELECT cluster_id, unit_id, size, spike_id, row_number() OVER (
            PARTITION BY cluster_id
            ORDER BY CASE WHEN width > 0 THEN round(1 - (size * amplitude * amplitude - 2 * amplitude * s1 + s2) / ((size - 1) * width ** 2), 6) ELSE 1 END DESC, spike_id)::INT AS rank
        FROM m WHERE size >= 3 QUALIFY rank <= 3""",
    "p5_found": """
        WITH RECURSIVE e AS (
            SELECT unit_a AS a, unit_b AS b FROM unit_pairs
            WHERE coin_ab >= 0.6 AND coin_ba >= 0.6 AND sim >= 0.8 AND NOT isnan(coin_ab) AND NOT isnan(coin_ba) AND NOT isnan(sim)),
        both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        reach AS (SELECT DISTINCT unit_id AS a, unit_id AS b FROM units UNION SELECT r.a, n.b FROM reach r JOIN both_ways n ON r.b = n.a)
        SELECT a AS unit_id, min(b) AS group_id FROM reach GROUP BY a""",
    "p6_within": """
        SELECT boss_row, boss_column, count(*) AS n, true AS within FROM (SELECT DISTINCT event_id, boss_row, boss_column, amplitude FROM basic_events
            WHERE boss_row IS NOT NULL AND boss_column IS NOT NULL AND amplitude IS NOT NULL AND NOT isnan(amplitude)) GROUP BY boss_row, boss_column""",
    "p6_found": """
        SELECT boss_row, boss_column
        FROM (SELECT DISTINCT event_id, boss_row, boss_column, amplitude FROM basic_events
              WHERE boss_row IS NOT NULL AND boss_column IS NOT NULL AND amplitude IS NOT NULL AND NOT isnan(amplitude))
        GROUP BY boss_row, boss_column
        HAVING quantile_cont(abs(amplitude), 0.5) >= 90 OR quantile_cont(abs(amplitude), 0.9) >= 180""",
}
