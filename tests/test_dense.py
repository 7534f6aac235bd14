import random

from pyspark.sql import functions as F

from arrayloom.operators.dense import top_per_key, totals_per_key

KIND = "row int, col int, event long, v double, key string"


def rows(n=4000):
    rng = random.Random(7)
    out = []
    for i in range(n):
        hot = rng.random() < 0.6
        key = (1, -2) if hot else (rng.randrange(30), rng.randrange(4))
        out.append((*key, i // 2 if rng.random() < 0.1 else i, round(rng.random() * 20, 1), None))
    once = {}
    for r in out:  # a repeated record has the same fields
        once.setdefault(r[2], r)
    return [once[r[2]] for r in out]


def brute(data, k):
    by = {}
    for r in {x[2]: x for x in data}.values():
        by.setdefault(r[:2], []).append((-r[3], r[2]))
    return sorted((*key, i) for key, v in by.items() for _, i in sorted(v)[:k])


def test_top(spark):
    data = rows()
    df = spark.createDataFrame(data, KIND).repartition(7)
    for k in (1, 3):
        got = top_per_key(df, ("row", "col"), "event", F.col("v"), k=k, blocks=5, fan=2)
        assert sorted((r.row, r.col, r.event) for r in got.collect()) == brute(data, k)


def test_totals(spark):
    data = rows(1500)
    want = {}
    for r in data:
        n, s = want.get(r[:2], (0, 0.0))
        want[r[:2]] = (n + 1, s + r[3])
    got = totals_per_key(spark.createDataFrame(data, KIND).repartition(5), ("row", "col"), F.col("v"), blocks=3).collect()
    assert {(r.row, r.col): (r.n, round(r.total, 6)) for r in got} == {k: (n, round(s, 6)) for k, (n, s) in want.items()}


def test_dirty(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, 1, 5, 2.0, "x"), (1, 1, 4, 2.0, "x"), (1, 1, 4, 2.0, "x"), (1, 1, 3, None, "x"), (1, 1, 2, nan, "x"), (None, 1, 1, 9.0, "x"),
            (1, None, 1, 9.0, "x"), (1, 1, None, 9.0, "x"), (1, 1, 9, inf, "x"), (2, 1, 8, -1.0, "x")]
    df = spark.createDataFrame(data, KIND)
    got = top_per_key(df, ("row", "col"), "event", F.col("v"), k=3)
    assert sorted((r.row, r.col, r.event, r.value) for r in got.collect()) == [(1, 1, 4, 2.0), (1, 1, 5, 2.0), (1, 1, 9, inf), (2, 1, 8, -1.0)]
    assert top_per_key(df.limit(0), ("row", "col"), "event", F.col("v")).collect() == []
    assert totals_per_key(df.limit(0), ("row", "col"), F.col("v")).collect() == []


def test_infinities_are_values(spark):
    inf = float("inf")
    rows = [(1, 1, 1, 5.0, None), (1, 1, 2, inf, None), (1, 1, 3, -inf, None), (1, 2, 4, -inf, None), (1, 2, 5, float("nan"), None)]
    got = top_per_key(spark.createDataFrame(rows, KIND).repartition(3), ("row", "col"), "event", F.col("v"), k=3).collect()
    assert sorted((r.row, r.col, r.event, r.value) for r in got) == [(1, 1, 1, 5.0), (1, 1, 2, inf), (1, 1, 3, -inf), (1, 2, 4, -inf)]
