import random

from arrayloom.llm.components import groups, solve_core


def brute(vertices, links):
    root = {v: v for v in vertices} | {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return sorted((v, find(v)) for v in root)


def run(spark, vertices, links):
    v = spark.createDataFrame([(x, "n") for x in vertices], "unit long, a string")
    e = spark.createDataFrame([(a, b, 1) for a, b in links], "a long, b long, unit int")
    return sorted(map(tuple, groups(v, "unit", e, "a", "b").collect()))


def test_shapes(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    cycle = [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    star = [(300, 301 + i) for i in range(12)]
    clique = [(a, b) for a in range(400, 406) for b in range(a + 1, 406)]
    joined = [(405, 500), (500, 501), (501, 502), (502, 400)]
    links = chain + cycle + star + clique + joined + [(1, 2), (2, 1), (1, 1), (1, 2)]
    assert run(spark, [1, 2, 3, 3], links) == brute([1, 2, 3], links)


def test_random(spark):
    rng = random.Random(5)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)]
    assert run(spark, range(120), links) == brute(range(120), links)


def test_core(spark):
    rng = random.Random(6)
    links = [(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(150)) if a != b]
    e = spark.createDataFrame(links, "u long, v long")
    got = sorted(map(tuple, solve_core(e).collect()))
    assert got == brute([], links)


def test_dirty(spark):
    v = spark.createDataFrame([(1,), (None,), (5,)], "unit long")
    e = spark.createDataFrame([(1, None), (None, 2), (None, None)], "a long, b long")
    assert sorted(map(tuple, groups(v, "unit", e, "a", "b").collect())) == [(1, 1), (5, 5)]
    assert groups(v.limit(0), "unit", e.limit(0), "a", "b").collect() == []
