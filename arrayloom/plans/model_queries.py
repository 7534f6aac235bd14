"""Queries of the numerical operators; their results are checked in tests against numpy where SQL can't."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arrayloom.functions import signal as S
from arrayloom.operators import decompose as D
from arrayloom.operators import density as N
from arrayloom.operators.agglomerate import agglomerate
from arrayloom.operators.joins import pairs_within
from arrayloom.plans.relation_queries import _SETS, _sets, _units
from arrayloom.plans.trace_queries import BY, _X, traces
from arrayloom.session import write_through
from arrayloom.sources.tables import table
from arrayloom.streaming.counts import once, run_to_table


def _frames(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors by label, as frames of a multichannel recording."""
    return table(spark, folder, "embeddings").select("label", F.col("vec_id").alias("frame"), F.col("embedding").cast("array<double>").alias("x"))


def _spikes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "unit_spikes").select("spike_id", "unit_id", "amplitude").filter("amplitude IS NOT NULL AND NOT isnan(amplitude)").distinct()


def covariance(spark, folder):
    return D.covariances(_frames(spark, folder), ["label"]).withColumn("c", F.round("c", 6) + 0.0)


def principal_variance(spark, folder):
    return D.principal_axes(_frames(spark, folder), ["label"]).select("label", "i", F.round("variance", 6).alias("variance"))


#: Frames of a region's trains that one task orders.
_STRETCH = 1024


def _train_runs(spark: SparkSession, folder: str, width: float = 20.0) -> DataFrame:
    """(roi_id, frame, x, zeros), written: the trains of each region's units as frames: spikes of every unit in bins of
    `width` ms. Trains are sparse, so a row stands for its frame and the `zeros` frames without a spike that follow it; all
    regions have the same frames. Regions of one unit have nothing to separate."""
    spikes = table(spark, folder, "unit_spikes").filter("time IS NOT NULL AND NOT isnan(time)").select("spike_id", "unit_id", F.floor(F.col("time") / width).alias("frame"))
    seen = spikes.groupBy("unit_id").agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    seen = write_through(seen.join(_units(spark, folder).select("unit_id", "roi_id"), "unit_id"))
    ends = seen.agg(F.min("a").alias("a"), F.max("b").alias("b"))  # one row
    mine = Window.partitionBy("roi_id")  # units of a region
    places = seen.select("unit_id", "roi_id", (F.row_number().over(mine.orderBy("unit_id")) - 1).alias("at"), F.count("*").over(mine).cast("int").alias("p")).filter("p > 1 AND roi_id IS NOT NULL")
    rows = spikes.join(places, "unit_id").select("roi_id", "p", "frame", "at", "spike_id")
    stretches = F.explode(F.sequence(F.floor(F.col("a") / _STRETCH), F.floor(F.col("b") / _STRETCH))).alias("stretch")
    starts = places.select("roi_id", "p").distinct().join(F.broadcast(ends)).select("roi_id", "p", "a", stretches)
    starts = starts.select("roi_id", "p", F.greatest("a", F.col("stretch") * _STRETCH).alias("frame"), F.lit(None).cast("int").alias("at"), F.lit(None).cast(spikes.schema["spike_id"].dataType).alias("spike_id"))
    by = ["roi_id", "stretch"]
    once = rows.unionByName(starts).withColumn("stretch", F.floor(F.col("frame") / _STRETCH)).repartition(*by).distinct()
    counts = once.groupBy(*by, "frame", "p", "at").agg(F.count("*").cast("double").alias("n"))
    frames = counts.groupBy(*by, "frame", "p").agg(F.map_from_entries(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "n")))).alias("m"))
    x = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    following = F.coalesce(F.lead("frame").over(Window.partitionBy(*by).orderBy("frame")), (F.col("stretch") + 1) * _STRETCH)
    runs = frames.select("roi_id", "frame", x.alias("x"), following.alias("next")).join(F.broadcast(ends))
    return write_through(runs.select("roi_id", "frame", "x", (F.least("next", F.col("b") + 1) - F.col("frame") - 1).alias("zeros")))


def _source_model(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frames, model): the distinct frames of the trains with the number `n` of their like, and the model of two sources."""
    quiet = runs.groupBy("roi_id").agg(F.sum("zeros").alias("n"), F.first(F.size("x")).alias("p"))
    frames = runs.select("roi_id", "x", F.lit(1).cast("bigint").alias("n")).unionByName(quiet.select("roi_id", F.array_repeat(F.lit(0.0), F.col("p")).alias("x"), "n"))
    return frames, D.ica_model(frames, ["roi_id"], 2, weight="n")


def independent_sources(spark, folder):
    """Two independent sources of the trains of each region, where the separation has settled."""
    runs = _train_runs(spark, folder)
    _, model = _source_model(runs)
    quiet = F.transform("m", lambda row: F.aggregate(F.zip_with(row, "mean", lambda a, b: a * b), F.lit(0.0), lambda a, b: a - b))  # of a frame without spikes
    settled = model.filter("converged").select("roi_id", "m", "mean", quiet.alias("quiet"))
    made = D.project(runs, settled, ["roi_id"], "frame", "zeros", "quiet")
    every = made.select("roi_id", "frame", "x", "quiet", F.explode(F.sequence(F.lit(0).cast("bigint"), "zeros")).alias("k"))
    v = F.when(F.col("k") == 0, F.col("x")).otherwise(F.col("quiet"))
    return every.select("roi_id", (F.col("frame") + F.col("k")).alias("frame"), F.posexplode(v).alias("component", "v"))


def source_covariance(spark, folder):
    """Covariances of those sources, settled or not: one with itself, none with another."""
    frames, model = _source_model(_train_runs(spark, folder))
    sources = D.project(frames, model, ["roi_id"], "n")
    return D.covariances(sources, ["roi_id"], "n").select("roi_id", "i", "j", (F.round("c", 6) + 0.0).alias("c"))


def embedded_axes(spark, folder):
    """Principal variances of each channel's trace stacked with its next lags."""
    stacked = S.lag_embed(traces(spark, folder), BY, 4)
    return D.principal_axes(D.frames_of(stacked, BY, "lag"), BY).select("channel", "i", F.round("variance", 6).alias("variance"))


def _filters(spark, folder):
    frames = _frames(spark, folder)
    each = frames.select("label", F.posexplode("x").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("v"))
    t = each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("t"))
    return D.optimal_filters(frames, ["label"], t.withColumn("unit", F.col("label")))


def variance_total(spark, folder):
    """The principal variances of each label in all: the trace of its covariance."""
    return D.principal_axes(_frames(spark, folder), ["label"]).groupBy("label").agg(F.count("*").alias("axes"), F.round(F.sum("variance"), 6).alias("total"))


def template_gain(spark, folder):
    """The mean of what each optimal filter makes of its label's frames: as their mean is its template, it is -1."""
    made = D.filtered_sources(_frames(spark, folder), _filters(spark, folder), ["label"])
    return made.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("gain"))


def optimal_filters(spark, folder):
    return _filters(spark, folder).select("label", "unit", F.posexplode("f").alias("i", "weight"))


def filtered_sources(spark, folder):
    return D.filtered_sources(_frames(spark, folder), _filters(spark, folder), ["label"])


def channel_crosstalk(spark, folder):
    """Crosstalk of all touching sensors, diagonal ones too, on the 10-row grid of the channels."""
    x = traces(spark, folder)
    places = x.select("channel").distinct().select("channel", (F.col("channel") % 10).alias("row"), F.expr("channel div 10").alias("col"))
    near = pairs_within(places, "channel", "row", "col", 1.5)
    return D.crosstalk(x, near, 3).withColumn("ratio", F.round("ratio", 6))


def upsampled(spark, folder):
    return S.upsample(traces(spark, folder), BY, 3).withColumn("v", F.round("v", 6))


def ar_whitened(spark, folder):
    out = S.fir(traces(spark, folder), BY, S.whitening_weights([1 / 3, -1 / 7], 1e-16))
    return out.select("channel", "frame", F.round("y", 6).alias("y"))


def threshold_isolation(spark, folder):
    """How far the spikes at or below each unit's mean amplitude stand apart from the rest."""
    spikes = _spikes(spark, folder)
    mean = spikes.groupBy("unit_id").agg(F.avg("amplitude").alias("m"))
    return N.isolation(spikes.join(mean, "unit_id").withColumn("valid", F.col("amplitude") <= F.col("m")), ["unit_id"], "amplitude", "valid")


def amplitude_mixtures(spark, folder):
    return N.mixtures(_spikes(spark, folder), ["unit_id"], "amplitude")


def _assigned(spark, folder):
    """Each spike with its amplitude cluster; written, as several passes read it."""
    spikes = _spikes(spark, folder)
    return write_through(N.assign(spikes, N.mixtures(spikes, ["unit_id"], "amplitude"), ["unit_id"], "amplitude", "spike_id"))


def winning_clusters(spark, folder):
    """The winning amplitude cluster of each unit, with its quality."""
    return N.winners(_assigned(spark, folder), ["unit_id"], "amplitude", _units(spark, folder))


def cluster_isolation(spark, folder):
    return N.winner_isolation(_assigned(spark, folder), ["unit_id"], "amplitude")


def greedy_regions(spark, folder):
    return agglomerate(_sets(spark, folder, "filename"), "roi", "pixel", 0.1, 169, "filename")


def region_members(spark, folder):
    """Sensor sets of each file, counted over its greedy regions: every set is in one of them."""
    return write_through(greedy_regions(spark, folder)).groupBy("filename").agg(F.count("*").alias("sets"), F.count_distinct("roi").alias("rois"))


def stream_once(spark, folder):
    """Each event of the stream of arrivals once, by sensor."""
    batch = table(spark, folder, "basic_events")
    stream = spark.readStream.schema(batch.schema).parquet(f"{folder}/basic_events.parque[t]")  # a pattern, as the table may be one file
    stream = stream.select("event_id", "boss_row", "boss_column", F.col("loaded_at").cast("timestamp").alias("loaded_at"))
    rows = run_to_table(once(stream, "event_id", "loaded_at", "2 days").select("event_id", "boss_row", "boss_column"))
    return rows.groupBy("boss_row", "boss_column").agg(F.count("*").alias("n"))


QUERIES = {
    "covariance": covariance,
    "principal_variance": principal_variance,
    "independent_sources": independent_sources,
    "source_covariance": source_covariance,
    "variance_total": variance_total,
    "template_gain": template_gain,
    "embedded_axes": embedded_axes,
    "optimal_filters": optimal_filters,
    "filtered_sources": filtered_sources,
    "channel_crosstalk": channel_crosstalk,
    "upsampled": upsampled,
    "ar_whitened": ar_whitened,
    "threshold_isolation": threshold_isolation,
    "amplitude_mixtures": amplitude_mixtures,
    "winning_clusters": winning_clusters,
    "cluster_isolation": cluster_isolation,
    "greedy_regions": greedy_regions,
    "region_members": region_members,
    "stream_once": stream_once,
}

_TAPS = S.lowpass(3)

SQL = {
    "source_covariance": """WITH U AS (SELECT unit_id, any_value(roi_id) AS roi_id FROM units GROUP BY unit_id), K AS (SELECT DISTINCT roi_id, unit_id FROM unit_spikes JOIN U USING (unit_id) WHERE time IS NOT NULL AND NOT isnan(time)),
        R AS (SELECT roi_id FROM K GROUP BY roi_id HAVING count(*) > 1) SELECT roi_id, i::INT AS i, j::INT AS j, (i = j)::INT::DOUBLE AS c FROM R, (VALUES (0, 0), (0, 1), (1, 1)) t(i, j)""",
    "variance_total": """WITH E AS (SELECT label, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), V AS (SELECT label, i, var_pop(v) AS v FROM E GROUP BY ALL)
        SELECT label, count(*) AS axes, round(sum(v), 6) AS total FROM V GROUP BY label""",
    "template_gain": "SELECT label, count(*) AS n, -1.0::DOUBLE AS gain FROM embeddings GROUP BY label",
    "region_members": f"WITH {_SETS} SELECT filename, count(DISTINCT roi) AS sets, count(DISTINCT roi) AS rois FROM ST WHERE filename IS NOT NULL GROUP BY filename",
    "covariance": """WITH E AS (SELECT label, vec_id, unnest(range(0, len(embedding)))::INT AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)
        SELECT x.label, x.i, y.i AS j, round(avg(x.v * y.v) - avg(x.v) * avg(y.v), 6) + 0.0 AS c FROM E x JOIN E y USING (label, vec_id) WHERE x.i <= y.i GROUP BY x.label, x.i, y.i""",
    "upsampled": f"""WITH {_X}, T AS (SELECT unnest({_TAPS}) AS tap, unnest(range(0, {len(_TAPS)})) - {len(_TAPS) // 2} AS d),
        N AS (SELECT channel, max(frame) AS last FROM X GROUP BY 1)
        SELECT channel, (frame - 1) * 3 + 1 + d AS frame, round(sum(v * tap), 6) AS v FROM X JOIN N USING (channel) CROSS JOIN T
        WHERE (frame - 1) * 3 + 1 + d BETWEEN 1 AND last * 3 GROUP BY ALL""",
    "ar_whitened": f"""WITH RECURSIVE {_X}, Z AS (
        SELECT channel, frame, v AS y, 0.0::DOUBLE AS y1 FROM X WHERE frame = 1
        UNION ALL SELECT X.channel, X.frame, X.v - y / 3 + y1 / 7, y FROM Z JOIN X ON X.channel = Z.channel AND X.frame = Z.frame + 1)
        SELECT channel, frame, round(y, 6) AS y FROM Z""",
    "stream_once": "SELECT boss_row, boss_column, count(*) AS n FROM (SELECT DISTINCT event_id, boss_row, boss_column FROM basic_events) GROUP BY ALL",
}
