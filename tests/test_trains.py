import numpy as np
import pytest

from arrayloom.operators import decompose as D
from arrayloom.plans import model_queries as M

FIRST, LAST = -3, 2100  # frames of all trains


@pytest.fixture
def folder(spark, tmp_path):
    """Two regions of three and two units whose trains are sparse and depend on one another, and one of a single unit."""
    rng = np.random.default_rng(7)
    roi = {11: 1, 12: 1, 13: 1, 21: 2, 22: 2, 31: 3}
    rows, spike = [], 0
    at = {u: rng.choice(np.arange(FIRST, LAST + 1), 60, replace=False) for u in roi}
    at[12] = np.r_[at[12], at[11][:20]]
    at[21] = np.r_[at[21], FIRST + 1024 - FIRST % 1024, at[22][:15]]
    at[31] = np.array([FIRST, LAST])
    for u, frames in at.items():
        for f in np.r_[frames, frames[:3]]:  # some bins hold two spikes
            rows.append((spike, u, float(20 * f + 5)))
            spike += 1
    rows += rows[:50] + [(spike, 11, None), (spike + 1, 11, float("nan")), (spike + 2, 99, 7.0)]
    spark.createDataFrame(rows, "spike_id long, unit_id long, time double").repartition(3).write.parquet(f"{tmp_path}/unit_spikes.parquet")
    units = [(u, r, "a") for u, r in roi.items()] + [(11, 1, None), (14, 1, "a")]
    spark.createDataFrame(units, "unit_id long, roi_id int, status string").write.parquet(f"{tmp_path}/units.parquet")
    dense = {}
    for r, us in {1: (11, 12, 13), 2: (21, 22)}.items():
        dense[r] = np.zeros((LAST - FIRST + 1, len(us)))
        for i, u in enumerate(us):
            np.add.at(dense[r][:, i], np.r_[at[u], at[u][:3]] - FIRST, 1)
    return str(tmp_path), dense


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    out = run()
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_sources_of_sparse_trains_are_those_of_all_frames(spark, folder):
    path, dense = folder
    rows = [(r, FIRST + k, [float(v) for v in x]) for r, m in dense.items() for k, x in enumerate(m)]
    df = spark.createDataFrame(rows, "roi_id int, frame long, x array<double>")
    (sources, model), _ = jobs_of(spark, "dense", lambda: D.fast_ica(df, ["roi_id"], 2))
    settled = {r.roi_id for r in model.collect() if r.converged}
    want = {(r.roi_id, r.frame, c): v for r in sources.collect() if r.roi_id in settled for c, v in enumerate(r.x)}
    got, jobs = jobs_of(spark, "sparse", lambda: M.independent_sources(spark, path).collect())
    assert settled and len(got) == len(want) == len({(r.roi_id, r.frame, r.component) for r in got})
    assert all(abs(r.v - want[r.roi_id, r.frame, r.component]) < 1e-9 for r in got)
    assert jobs < 50  # not some for each round


def test_rounds_of_few_components_take_no_pass(spark, folder):
    rows = [(r, k, [float(v) for v in x]) for r, m in folder[1].items() for k, x in enumerate(m)]
    df = spark.createDataFrame(rows, "roi_id int, frame long, x array<double>")
    once, few = jobs_of(spark, "one round", lambda: D.fast_ica(df, ["roi_id"], 2, rounds=1)[1].collect())
    more, many = jobs_of(spark, "many rounds", lambda: D.fast_ica(df, ["roi_id"], 2, tolerance=1e-12)[1].collect())
    assert many == few and once != more
