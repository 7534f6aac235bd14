import numpy as np

from arrayloom.operators.sorting import sort_regions


def planted(neurons, seed=0, n=6000, channels=4):
    rng = np.random.default_rng(seed)
    x, times = rng.normal(0, 0.3, (channels, n)), []
    shape = -np.array([0.2, 0.6, 1.0, 0.6, 0.2])
    for k in range(neurons):
        at = np.sort(rng.choice(np.arange(20, n - 20, 12), 60, replace=False)) + k * 3
        gain = np.zeros(channels)
        gain[k], gain[k + 1] = 8 + k, 3
        for t in at:
            x[:, t - 2 : t + 3] += np.outer(gain * rng.normal(1, 0.03), shape)
        times.append(at + 1)
    return x, times


def test_planted_neurons(spark):
    x, times = planted(2)
    quiet, _ = planted(0, seed=5)
    rows = [(r, c, f + 1, float(m[c, f])) for r, m in ((1, x), (2, quiet)) for c in range(4) for f in range(m.shape[1])]
    traces = spark.createDataFrame(rows, "roi_id int, channel int, frame long, v double")
    units, spikes, templates, filters = sort_regions(traces, 2, "instantaneous", times_sigma=5.0)
    every = units.collect()
    assert {(u.roi_id, u.status) for u in every if u.roi_id == 2} == {(2, "noise")}
    got = [u for u in every if u.status == "kept"]
    assert {u.roi_id for u in got} == {1} and sorted(u.boss_channel for u in got) == [0, 1]
    assert all(u.converged and u.snr > 5 and u.separability > 5 and u.sd_score > 0 for u in got)
    # the channel in which a source stands most is the unit's boss channel
    weights = {(f.comp, f.channel): abs(f.weight) for f in filters.filter("roi_id = 1").collect()}
    assert all(max(range(4), key=lambda c: weights[u.comp, c]) == u.boss_channel for u in got)
    assert templates.filter("roi_id = 1").count() == 2 * 4 * 11
    found = {}
    for s in spikes.collect():
        found.setdefault(s.comp, []).append(s.frame)
    for u in got:
        truth = times[u.boss_channel]
        hit = [min(abs(truth - f)) <= 1 for f in found[u.comp]]
        assert np.mean(hit) > 0.9 and len(hit) > 0.8 * len(truth)


def test_the_default_way_finds_the_number_of_sources(spark):
    """Stacked lags, number of sources from the spectrum, filters back on channels and lags."""
    x, times = planted(2, seed=3, n=4000)
    rows = [(1, c, f + 1, float(x[c, f])) for c in range(4) for f in range(x.shape[1])]
    traces = spark.createDataFrame(rows, "roi_id int, channel int, frame long, v double")
    units, spikes, _, filters = sort_regions(traces, times_sigma=5.0)
    got = [u for u in units.collect() if u.status == "kept"]
    assert {u.boss_channel for u in got} == {0, 1}
    n = units.count()
    assert filters.count() == n * 4 * 7 and {f.lag for f in filters.collect()} == set(range(7))
    found = {}
    for s in spikes.collect():
        found.setdefault(s.comp, []).append(s.frame)
    for boss in (0, 1):  # some source of each neuron follows its spikes, within the lags
        shares = [np.mean([np.min(np.abs(times[boss] - f)) <= 7 for f in found[u.comp]]) for u in got if u.boss_channel == boss]
        assert max(shares) > 0.9
