import numpy as np
import pytest
from pyspark.sql import functions as F

from arrayloom.functions import signal as S

BY = ["channel"]


def trace(spark, *channels):
    rows = [(c, i + 1, float(v)) for c, x in enumerate(channels) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "channel int, frame long, v double")


def test_noise_and_moments(spark):
    df = trace(spark, [0, -1, -5, -1, 0, 1, -4, 0])
    r = S.moments(df, BY).collect()[0]
    assert r.skewn == pytest.approx(-0.8999154119267314) and r.kurt == pytest.approx(2.3212396069538928)
    assert S.noise_sigma(df, BY).collect()[0].sigma == pytest.approx(1 / 0.6745)


@pytest.mark.parametrize("chunk", [3, 7, 1000])
def test_chunks_do_not_matter(spark, chunk):
    rng = np.random.default_rng(1)
    x = rng.normal(size=200)
    df = trace(spark, x, x[:5])
    got = sorted((r.channel, r.frame) for r in S.peaks(df, BY, 1.0, chunk=chunk).collect())
    want = []
    for c, y in enumerate((x, x[:5])):
        s = np.median(np.abs(y)) / 0.6745
        want += [(c, i + 1) for i in range(1, len(y) - 1) if -y[i] > s and -y[i] > -y[i - 1] and -y[i] >= -y[i + 1]]
    assert got == want
    w = [0.5, -0.2, 0.1, 0.3]
    y = {(r.channel, r.frame): r.y for r in S.fir(df, BY, w, chunk=chunk).collect()}
    full = np.convolve(x, w)[: len(x)]
    assert np.allclose([y[0, i + 1] for i in range(200)], full)
    r = {(a.channel, a.lag): a.r for a in S.autocorrelation(df, BY, 4, chunk=chunk).collect()}
    assert np.allclose([r[0, k] for k in range(5)], [x[k:] @ x[: 200 - k] / (200 - k) for k in range(5)])


@pytest.mark.parametrize("chunk", [2, 100])
def test_onset_and_dilation(spark, chunk):
    df = trace(spark, [0, 1, 5, 3, 0])
    got = S.onset_peaks(df, BY, F.lit(2.0), 2, chunk=chunk).collect()
    assert [(r.onset, r.frame, r.peak) for r in got] == [(2, 3, 5.0)]
    seeds = trace(spark, [0, 0, 0, 1, 0, 0, 0, 0, 1, 0]).withColumn("seed", F.col("v") > 0).withColumn("total", F.lit(10))
    mask = {r.frame: r.mask for r in S.dilate(seeds, BY, "seed", 2, "total", chunk=chunk).collect()}
    assert "".join(str(int(mask[i])) for i in range(1, 11)) == "0111110010"


def test_embedding_and_snippets(spark):
    df = trace(spark, [1, 2, 3, 4])
    rows = {(r.frame, r.lag): r.v for r in S.lag_embed(df, BY, 2, chunk=3).collect()}
    assert [rows[i, 0] for i in range(1, 5)] == [1, 2, 0, 0] and [rows[i, 1] for i in range(1, 5)] == [2, 3, 0, 0]
    spikes = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "channel int, frame long")
    got = sorted((r.spike, r.lag, r.v) for r in S.snippets(df, spikes, BY, 1, 1).collect())
    assert got == [(2, -1, 1.0), (2, 0, 2.0), (2, 1, 3.0), (3, -1, 2.0), (3, 0, 3.0), (3, 1, 4.0)]


def test_upsampling_keeps_a_slow_wave(spark):
    t = np.arange(120)
    df = trace(spark, np.sin(t / 6))
    got = {r.frame: r.v for r in S.upsample(df, BY, 3, chunk=17).collect()}
    fine = [got[i + 1] for i in range(90, 240)]
    assert np.abs(np.array(fine) - np.sin(np.arange(90, 240) / 18)).max() < 0.02
    assert sorted(got) == list(range(1, 361))


def test_whitening_is_the_recursion(spark):
    x = np.random.default_rng(3).normal(size=60)
    model, z = [0.5, -0.2], []
    for t in range(60):
        z.append(x[t] - sum(model[m] * z[t - m - 1] for m in range(2) if t - m - 1 >= 0))
    got = S.fir(trace(spark, x), BY, S.whitening_weights(model, 1e-14)).orderBy("frame").collect()
    assert np.allclose([r.y for r in got], z)
    with pytest.raises(ValueError):
        S.whitening_weights([-1.5])


def test_energy_and_histogram(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4, 5, 9))
    rows = [(r, c, f + 1, float(x[r, c, f])) for r in range(4) for c in range(5) for f in range(9)]
    df = spark.createDataFrame(rows, "row int, col int, frame long, v double")
    got = {(r.row, r.col, r.frame): r.energy for r in S.neighbourhood_energy(df, 1, 1, 2, chunk=4).collect()}
    assert len(got) == 2 * 3 * 5
    for (r, c, f), e in got.items():
        assert e == pytest.approx((x[r - 1 : r + 2, c - 1 : c + 2, f - 3 : f + 2] ** 2).sum())
    h = S.histogram(trace(spark, [0, 1, 2, 3, 4, 5, 6, 7, 8]), BY, "v").orderBy("bin").collect()
    assert [(r.bin, r.n) for r in h] == [(0, 3), (1, 3), (2, 3)]


def test_median_in_passes(spark):
    """Narrowing down gives the same medians as sorting, whatever the values are."""
    rng = np.random.default_rng(6)
    groups = {0: rng.normal(size=3001), 1: rng.normal(size=3000), 2: np.r_[np.zeros(900), np.ones(900)], 3: np.full(2000, 7.5), 4: np.array([1.0, 4.0]), 5: np.r_[rng.normal(size=1500), 1e300, -1e300, np.inf]}
    groups[6] = np.exp(rng.normal(0, 8, 2500))
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [(0, None), (0, float("nan"))]
    df = spark.createDataFrame(rows, "channel int, v double")
    for most in (50, 10**6):
        got = {r.channel: r["median"] for r in S.medians(df, BY, F.col("v"), most).collect()}
        assert got == {k: float(np.median(v)) for k, v in groups.items()}
