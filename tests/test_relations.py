import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrayloom.operators import joins as J
from arrayloom.operators import units as U
from arrayloom.operators.agglomerate import agglomerate
from arrayloom.operators.components import connected_components, single_linkage
from arrayloom.operators.events import from_linear, linear_index
from arrayloom.operators.order import order_estimates


def test_band_is_the_naive_join(spark):
    rng = random.Random(1)
    a = [(rng.randrange(3), i, rng.random() * 30) for i in range(80)]
    b = [(rng.randrange(3), rng.random() * 30) for _ in range(80)]
    got = J.band_pairs(spark.createDataFrame(a, "g int, i int, x double"), spark.createDataFrame(b, "g int, y double"), ["g"], "x", "y", 0.7)
    assert sorted((r.i, r.y) for r in got.collect()) == sorted((i, y) for g, i, x in a for h, y in b if g == h and abs(x - y) <= 0.7)


def test_coincidences_need_exactly_one(spark):
    a = spark.createDataFrame([(0, i, t) for i, t in enumerate((10.0, 20.0, 30.0, 40.0))], "g int, i int, x double")
    b = spark.createDataFrame([(0, t) for t in (10.5, 20.2, 20.8, 41.5)], "g int, y double")
    assert [r.i for r in J.coincidences(a, b, ["g"], "x", "y", 1.0, "i").collect()] == [0]


def test_asof(spark):
    refs = spark.createDataFrame([("r", float(i), i + 1) for i in range(4)], "rec string, at double, frame int")
    probes = spark.createDataFrame([("r", 1.0), ("r", 1.5), ("r", 3.0), ("r", -0.5), ("r", 99.0), ("q", 1.0), ("r", None)], "rec string, t double")
    for width in (0.7, 50.0):
        got = {(r.rec, r.t): r.frame for r in J.asof_backward(probes, refs, ["rec"], "t", "at", "frame", width).collect()}
        assert got == {("r", 1.0): 2, ("r", 1.5): 2, ("r", 3.0): 4, ("r", -0.5): None, ("r", 99.0): 4, ("q", 1.0): None, ("r", None): None}


def test_overlap_and_boxes(spark):
    sets = spark.createDataFrame([(1, x) for x in (1, 2, 3, 3)] + [(2, x) for x in (2, 3, 4, 5)] + [(3, 9)], "k int, m int")
    assert [(r.a, r.b, r.common, round(r.overlap, 6)) for r in J.set_overlap(sets, "k", "m").collect()] == [(1, 2, 2, 0.666667)]
    same = spark.createDataFrame([(7, x) for x in (3, 2, 1)] + [(8, 9), (8, None)], "k int, m int")
    assert sorted((r.a, r.b) for r in J.equal_sets(sets, same, "k", "m").collect()) == [(1, 7), (3, 8)]
    boxes = spark.createDataFrame([(0, 1, 20, 1, 3)], "box int, r0 int, r1 int, c0 int, c1 int")
    points = spark.createDataFrame([(20, 3), (21, 3), (1, 1), (5, 0)], "row int, col int")
    assert sorted((r.row, r.col) for r in J.in_boxes(points, "row", "col", boxes, 7).collect()) == [(1, 1), (20, 3)]


def test_pairs_within(spark):
    rng = random.Random(2)
    p = [(i, rng.randrange(12), rng.randrange(12)) for i in range(60)]
    got = J.pairs_within(spark.createDataFrame(p, "k int, x int, y int"), "k", "x", "y", 2.5).collect()
    want = [(a, b) for a, x, y in p for b, u, v in p if a < b and ((x - u) ** 2 + (y - v) ** 2) ** 0.5 <= 2.5]
    assert sorted((r.a, r.b) for r in got) == sorted(want)


def test_components(spark):
    rng = random.Random(3)
    e = [(rng.randrange(80), rng.randrange(80)) for _ in range(55)] + [(100 + i, 101 + i) for i in range(30)]
    root = {x: x for p in e for x in p} | {500: 500}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in e:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    v = spark.createDataFrame([(x,) for x in root], "v long")
    got = connected_components(spark.createDataFrame(e, "a long, b long"), "a", "b", v, "v").collect()
    assert {r.v: r.component for r in got} == {x: find(x) for x in root}


def test_single_linkage_and_agglomeration(spark):
    sim = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.5), (3, 4, 0.1), (4, 1, float("nan"))], "a int, b int, s double")
    v = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "v int")
    assert {r.v: r.component for r in single_linkage(sim, "a", "b", "s", 0.4, v, "v").collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    sets = {1: (1, 2, 3), 2: (3, 4), 3: (4, 5), 4: (9,)}
    df = spark.createDataFrame([(k, m) for k, ms in sets.items() for m in ms], "k int, m int")
    assert {r.k: r.region for r in agglomerate(df, "k", "m", 0.1, 4).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_linear_index(spark):
    df = spark.createDataFrame([(2, 3)], "row int, col int").withColumn("i", linear_index(F.col("row"), F.col("col"), 5))
    row, col = from_linear(F.col("i"), 5)
    assert df.select("i", row, col).collect()[0] == (12, 2, 3)


def test_order_rules(spark):
    df = spark.createDataFrame([(0, x) for x in (10.0, 6.0, 3.0, 1.1, 1.0, 0.95, 0.75, 0.7)], "g int, x double")
    r = order_estimates(df, ["g"], "x", 1000.0).collect()[0]
    assert (r.n, r.by_median, r.by_mean, r.by_line, r.by_aic, r.by_mdl) == (8, 4, 4, 4, 6, 3)


def test_units(spark):
    t = spark.createDataFrame([(1, 1, 1, 0, 5.0), (1, 2, 1, 1, -5.0), (1, 1, 1, 1, None), (2, 3, 3, 0, 1.0)], "unit_id int, sensor_row int, sensor_col int, lag int, v double")
    assert sorted((r.unit_id, r.boss_row, r.boss_col, r.lag) for r in U.boss_sensors(t).collect()) == [(1, 1, 1, 0), (2, 3, 3, 0)]
    nan = float("nan")
    u = spark.createDataFrame([(1, 1, 2.0), (2, 1, 3.0), (3, 1, 3.0), (4, 1, nan), (5, 2, None)], "u int, g int, s double")
    assert {r.u: r.keep for r in U.keep_best(u, "g", "s").collect()} == {1: False, 2: True, 3: True, 4: False, 5: True}
    assert sorted(r.u for r in U.select_by_range(u, "s", low=2.5).collect()) == [2, 3, 4]
    n = U.numbered(u.repartition(3), ["g", "u"]).collect()
    assert {r.u: r.running_id for r in n} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5}


def test_coincidence_fractions(spark):
    s = spark.createDataFrame([(i, 1, t) for i, t in enumerate((10.0, 20.0, 30.0, 40.0))] + [(9 + i, 2, t) for i, t in enumerate((10.5, 20.2, 20.8, 41.5))], "spike_id int, unit_id int, time double")
    p = spark.createDataFrame([(1, 2)], "a int, b int")
    r = U.coincidence_fractions(s, p, 1.0).collect()[0]
    assert (r.n, r.frac_a, r.frac_b) == (1, 0.25, 0.25)
    assert U.best_lag(s, p, 0.5, 3).collect()[0].n >= 1
    assert r.n == pytest.approx(1)


def test_numbers_within_groups(spark):
    rng = np.random.default_rng(8)
    keys = ["a"] * 500 + ["b"] * 3 + [None] * 20 + ["c"] * 90
    rows = [(k, float(t), i) for i, (k, t) in enumerate(zip(keys, rng.permutation(len(keys))))]
    want = {}
    for k in set(keys):
        for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: r[1])):
            want[r[2]] = n + 1
    df = spark.createDataFrame(rows, "k string, t double, id long").repartition(5)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for size, tasks in ((7, 6), (1000, 3)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            spark.conf.set("spark.sql.shuffle.partitions", tasks)
            assert {r.id: r.n for r in U.numbered_within(df, ["k"], ["t"], "n").collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old[0])
        spark.conf.set("spark.sql.shuffle.partitions", old[1])
    assert U.numbered_within(df.limit(0), ["k"], ["t"], "n").collect() == []
