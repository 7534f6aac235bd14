import numpy as np
from pyspark.sql import functions as F

from arrayloom.llm import quantiles as Q

KIND = "a int, b int, v double, extra string"


def test_encode_keeps_order():
    x = np.r_[np.random.default_rng(1).normal(0, 100, 5000), 0.0, -0.0, 1e-300, 1e300, -1e300, np.inf, -np.inf, 90.0, 180.0]
    x.sort()
    c = Q.encode(x)
    assert (np.diff(c) >= 0).all() and c.min() >= 0 and c.max() < 1 << Q.BITS
    mid = (np.abs(x) > 1e-30) & (np.abs(x) < 1e30)
    assert (np.abs(Q.decode(c[mid]) - x[mid]) <= np.abs(x[mid]) * 2.0 ** -(Q.BITS - 9)).all()
    assert Q.decode(Q.encode(np.array([90.0, 180.0]))).tolist() == [90.0, 180.0]


def test_error_bound(spark):
    rng = np.random.default_rng(2)
    values = rng.gamma(2, 40, 60_000)
    df = spark.createDataFrame([(1, 2, float(v), None) for v in values[:20_000]], KIND).unionByName(
        spark.createDataFrame([(1, 2, float(v), None) for v in values[20_000:]], KIND)
    )
    ask = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]
    row = Q.quantiles(Q.merge_sketches(Q.sketches(df, ("a", "b"), F.col("v"))), ("a", "b"), ask).collect()[0]
    values.sort()
    ranks = np.searchsorted(values, row.quantiles) / len(values)
    assert row.n == len(values) and np.abs(ranks - ask).max() < 0.01
    assert np.abs(ranks - ask).max() <= row.rank_error < 0.03


def test_merge_and_delete(spark):
    day = [spark.createDataFrame([(1, -1, float(i), None) for i in range(start, 6000, 2)], KIND) for start in (0, 1)]
    extra = spark.createDataFrame([(1, -1, 1e6, None)] * 3000, KIND)
    parts = Q.sketches(day[0], ("a", "b"), F.col("v")).unionByName(Q.sketches(day[1].unionByName(extra), ("a", "b"), F.col("v")))
    parts = parts.unionByName(Q.sketches(extra, ("a", "b"), F.col("v"), F.lit(-1)))
    row = Q.quantiles(Q.merge_sketches(parts), ("a", "b"), [0.5]).collect()[0]
    assert (row.a, row.b, row.n) == (1, -1, 6000) and abs(row.quantiles[0] - 3000) < 120


def test_dirty_and_small(spark):
    rows = [(1, 1, None, None), (1, 1, float("nan"), None), (None, 1, 1.0, None), (1, None, 1.0, None), (2, 3, -4.0, None), (2, 3, 8.0, None), (2, 3, 0.0, None)]
    out = Q.quantiles(Q.merge_sketches(Q.sketches(spark.createDataFrame(rows, KIND), ("a", "b"), F.col("v"))), ("a", "b"), [0.0, 0.25, 0.5, 1.0]).collect()
    assert [(r.a, r.b, r.n, r.quantiles) for r in out] == [(2, 3, 3, [-4.0, -2.0, 0.0, 8.0])]
    empty = spark.createDataFrame([], KIND)
    assert Q.quantiles(Q.merge_sketches(Q.sketches(empty, ("a", "b"), F.col("v"))), ("a", "b"), [0.5]).collect() == []


def test_width_for_an_error(spark):
    """A wider sketch keeps the error that was asked for, and says so."""
    rng = np.random.default_rng(3)
    values = np.r_[rng.normal(100, 1, 40_000), rng.gamma(2, 40, 20_000)]
    width = Q.width_for(0.004, 0.05)
    df = spark.createDataFrame([(1, 2, float(v), None) for v in values], KIND).repartition(4)
    parts = Q.sketches(df, ("a", "b"), F.col("v"), width=width)
    row = Q.quantiles(Q.merge_sketches(parts, width), ("a", "b"), [0.05, 0.5, 0.95], width).collect()[0]
    values.sort()
    low, high = (np.searchsorted(values, np.array(row.quantiles) * (1 + s * 2.0**-11), side) / len(values) for s, side in ((-1, "left"), (1, "right")))
    ask = np.array([0.05, 0.5, 0.95])
    assert width > Q.WIDTH and row.rank_error <= 0.01 and (low <= ask + row.rank_error).all() and (high >= ask - row.rank_error).all()


def test_many_keys_in_few_tasks(spark, monkeypatch):
    """More sketches than a task may hold are handed on early; results stay the same."""
    monkeypatch.setattr(Q, "HELD_BYTES", 1 << 16)
    monkeypatch.setattr(Q, "OUT_BYTES", 1 << 14)
    rows = [(k, -k, float(i), None) for k in range(300) for i in range(40)]
    parts = Q.sketches(spark.createDataFrame(rows, KIND).repartition(2), ("a", "b"), F.col("v"))
    got = {(r.a, r.b): (r.n, r.quantiles) for r in Q.quantiles(parts, ("a", "b"), [0.0, 1.0]).collect()}
    assert got == {(k, -k): (40, [0.0, 39.0]) for k in range(300)}
