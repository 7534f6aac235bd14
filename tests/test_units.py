import pytest
from pyspark.sql import functions as F

from arrayloom.operators import events as E
from arrayloom.operators import joins as J
from arrayloom.operators import units as U
from arrayloom.operators.agglomerate import agglomerate
from arrayloom.sources.recording import recordings
from arrayloom.sources.text_tables import read_events


def test_shifted_trains_coincide(spark):
    """A train that lags behind by 2 ms shares no spike within 0.5 ms, and all of them after the best shift."""
    rows = [(i, 1, 10.0 * i) for i in range(20)] + [(100 + i, 2, 10.0 * i - 2.0) for i in range(20)] + [(200, 3, 5000.0)]
    spikes = spark.createDataFrame(rows, "spike_id long, unit_id long, time double")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    assert U.coincidence_fractions(spikes, pairs, 0.5).collect() == []
    got = U.shifted_coincidences(spikes, pairs, 0.5, 6, 0.5).collect()
    assert [(r.a, r.b, r.lag, r.n, r.frac_a, r.frac_b) for r in got] == [(1, 2, 4, 20, 1.0, 1.0)]


def test_moved_threshold_and_backfill(spark):
    nan = float("nan")
    peaks = spark.createDataFrame([(1, -10.0), (1, -12.0), (1, -4.0), (1, None), (1, nan), (2, -9.0), (3, -1.0)], "unit_id int, amplitude double")
    limits = spark.createDataFrame([(u, -5.0, 2.0) for u in (1, 2, 3)], "unit_id int, threshold double, noise_std double")
    got = {r.unit_id: (r.n, r.mean_amp, r.separability) for r in U.rethreshold(peaks, limits, ["unit_id"]).collect()}
    assert got == {1: (2, 11.0, 3.5), 2: (1, 9.0, 4.5)}
    units = spark.createDataFrame([(1, nan), (2, None), (3, 5.0), (4, nan)], "unit_id int, skewn double")
    filled = U.backfill(units, spark.createDataFrame([(1, 7.0), (2, 8.0), (3, 9.0)], "unit_id int, skewn double"), ["unit_id"], ["skewn"])
    values = {r.unit_id: r.skewn for r in filled.collect()}
    assert values[4] != values[4] and {k: values[k] for k in (1, 2, 3)} == {1: 7.0, 2: 8.0, 3: 5.0}


def test_recordings_are_apart(spark):
    df = spark.createDataFrame([(f, k, m) for f in ("x", "y") for k, ms in {1: (1, 2, 3), 2: (3, 4), 3: (4, 5), 4: (9,)}.items() for m in ms], "f string, k int, m int")
    got = {(r.f, r.k): r.region for r in agglomerate(df, "k", "m", 0.1, 4, "f").collect()}
    assert got == {(f, k): r for f in ("x", "y") for k, r in {1: 1, 2: 1, 3: 3, 4: 4}.items()}


def test_classes_of_equal_sets(spark):
    df = spark.createDataFrame([(1, 5), (1, 6), (1, 6), (2, 6), (2, 5), (3, 5), (4, 7), (5, 7), (6, None)], "k int, m int")
    assert {r.k: r["class"] for r in J.set_classes(df, "k", "m").collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_positions_and_masks(spark):
    ids = spark.createDataFrame([("row", 2), ("row", 4), ("row", 4), ("col", 7), ("col", None)], "kind string, id int")
    sensors = spark.createDataFrame([(1, 4, 7), (2, 2, 7)], "id int, r int, c int")
    assert sorted((r.id, r.row_at, r.col_at) for r in J.positions(sensors, "r", "c", ids).collect()) == [(1, 2, 1), (2, 1, 1)]
    with pytest.raises(Exception, match="sensor was not read out: 3, 7"):
        J.positions(spark.createDataFrame([(1, 3, 7)], "id int, r int, c int"), "r", "c", ids).collect()
    frames = spark.createDataFrame([(1,), (5,), (5,), (None,), (10,)], "frame long")
    assert sorted(r.frame for r in E.frame_mask(frames, 2).collect()) == [1, 3, 4, 5, 6, 7, 10]
    assert E.frame_mask(frames.limit(0), 2).collect() == []


def test_readers_refuse_what_they_do_not_know(spark, tmp_path):
    frames = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 2.0)], "rec_id string, t_ms double")
    sensors = spark.createDataFrame([("a", 3, 8), ("a", 1, 8)], "rec_id string, row int, col int")
    def facts(chip, version):
        return recordings(frames, sensors, spark.createDataFrame([("a", chip, version)], "rec_id string, chip string, version string")).collect()
    r = facts("NCA", "NH5_1.0.0")[0]
    assert (r.frames, r.sr_khz, r.rows, r.cols, r.pitch) == (3, 1.5, [1, 3], [8], 16.0)
    for chip, version in (("NCA", "2"), ("other", "NH5_1.0.0")):
        with pytest.raises(Exception, match="unknown"):
            facts(chip, version)
    path = tmp_path / "events.tsv"
    path.write_text("filename\tplace\ttime\tamplitude\tboss_column\tboss_row\tsensors\nf\t1\t2.5\t-3.5\t7\t8\t(1,2)(3,4)\n")
    row = read_events(spark, str(path)).collect()[0]
    assert (row.time, row.boss_row, row.sensors) == (2.5, 8, "(1,2)(3,4)")
    path.write_text("filename\tplace\ttime\tamplitude\tboss_column\tboss_row\tsensors\nf\t1\t2.5\t-3.5\t7\t8\t(\n")
    with pytest.raises(Exception, match="not a list of sensors"):
        read_events(spark, str(path)).select(F.col("sensors")).collect()


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from arrayloom import session

    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_redundancy_compares_only_pairs_that_may_be_one(spark, monkeypatch):
    """Sixty units of one block, each with one spike by chance near those of all others: only the unit that is there twice
    is compared with its double. A unit without templates or place stays alone."""
    rows = [(1000 * u + i, u, 500.0 * i + 7.0 * u + (0.3 if u == 2 else 0.0)) for u in range(1, 61) for i in range(1, 9)]
    rows += [(1000 * u, u, 9e4) for u in range(1, 61)] + [(100_000 + i, 70, 500.0 * i + 14.2) for i in range(1, 9)] + [(200_000, 80, None)]
    spikes = spark.createDataFrame(rows, "spike_id long, unit_id long, time double")
    units = spark.createDataFrame([(u, u % 3, 4) for u in (*range(1, 61), 70)] + [(80, None, None)], "unit_id long, r int, c int")
    shape = [(u, u % 3 + o, 4, lag, -50.0 / (1 + lag * lag + o)) for u in (*range(1, 61), 70) for o in (0, 1) for lag in (-1, 0, 1)]
    templates = spark.createDataFrame(shape, "unit_id long, sensor_row int, sensor_col int, lag int, v double")
    compared = []
    real = U.shifted_coincidences
    monkeypatch.setattr(U, "shifted_coincidences", lambda s, p, *rest: compared.append((s.count(), p.count())) or real(s, p, *rest))
    got = {r.unit_id: (r.block, r.component) for r in U.redundancy_groups(units, spikes, templates, "r", "c", 1.5, 0.25, 2, 1.0, 0.5, 0.5).collect()}
    assert got == {u: (1, 2 if u == 70 else u) for u in (*range(1, 61), 70)} | {80: (80, 80)}
    assert compared == [(17, 1)]


def test_wide_buckets_lose_no_pair(spark):
    left = spark.createDataFrame([(i, i * 0.7) for i in range(-20, 60)], "i int, x double")
    right = spark.createDataFrame([(j, j * 0.5 - 3.0) for j in range(80)], "j int, y double")
    got = sorted((r.i, r.j) for r in J.band_pairs(left.withColumn("g", F.lit(1)), right.withColumn("g", F.lit(1)), ["g"], "x", "y", 0.75, 4).collect())
    assert got == [(i, j) for i in range(-20, 60) for j in range(80) if abs(i * 0.7 - (j * 0.5 - 3.0)) <= 0.75]
