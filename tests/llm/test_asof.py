import random

from pyspark.sql import functions as F

from arrayloom.llm.asof import label_key, nearest_in_time

LEFT, RIGHT = "gt long, e string, t double, extra string", "sp long, e string, t double, extra int"


def run(spark, left, right, tolerance=0.5, tasks=None):
    if tasks:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        out = nearest_in_time(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), "e", "t", "gt", "sp", tolerance)
        return sorted(map(tuple, out.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 3)


def brute(left, right, tolerance):
    out = set()
    for gt, e, t, _ in left:
        if e is None or t is None or t != t:
            continue
        near = [(abs(t - rt), sp) for sp, re, rt, _ in right if re == e and rt is not None and rt == rt and abs(t - rt) <= tolerance]
        if near:
            out.add((gt, min(near)[1]))
    return sorted(out)


def test_edges_between_tasks(spark):
    """One entity over many tasks: the right records lie in other partitions than the left ones."""
    left = [(i, "a", 10.0 + i * 0.001, None) for i in range(300)]
    right = [(7, "a", 9.9, 1), (8, "a", 10.4, 1), (9, "b", 10.1, 1)]
    assert run(spark, left, right, tasks=9) == brute(left, right, 0.5)


def test_random(spark):
    rng = random.Random(3)
    left = [(i, rng.choice("abc"), round(rng.random() * 40, 1), None) for i in range(400)]
    right = [(i, rng.choice("abcd"), round(rng.random() * 40, 1), 1) for i in range(150)]
    assert run(spark, left, right, tasks=7) == brute(left, right, 0.5)


def test_dirty(spark):
    nan = float("nan")
    left = [(1, "a", 1.0, None), (1, "a", 1.0, "x"), (2, None, 1.0, None), (3, "a", None, None), (4, "a", nan, None), (5, "a", 9.0, None)]
    right = [(20, "a", 1.25, 1), (10, "a", 0.75, 1), (11, "a", 0.75, 1), (3, "a", None, 1), (4, "a", nan, 1), (None, "a", 1.0, 1)]
    assert run(spark, left, right) == [(1, 10)]
    assert run(spark, [], right) == [] and run(spark, left, []) == []


def test_label_key(spark):
    df = spark.createDataFrame([("N1\t",), ("  n1",), (None,)], "x string").select(label_key(F.col("x")).alias("k"))
    assert [r.k for r in df.collect()] == ["n1", "n1", None]


def test_a_partition_in_many_batches(spark):
    """Carried right records and held left rows give the same pairs whatever the size of a batch."""
    rng = random.Random(9)
    left = [(i, rng.choice("ab"), round(rng.random() * 30, 2), None) for i in range(300)] + [(1000 + i, "c", 5.0, None) for i in range(40)] + [(7, "a", 3.0, None)] * 9
    right = [(i, rng.choice("abd"), round(rng.random() * 30, 1), 1) for i in range(60)] + [(900, "c", 5.25, 1), (901, "c", 4.75, 1)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (1, 7, 50):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert run(spark, left, right, tasks=2) == brute(left, right, 0.5)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
