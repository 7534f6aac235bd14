from arrayloom.llm.spectral import most_typical, similarity_clusters

ROWS, WIDTHS = "m long, u long, v double, extra string", "u long, w double, extra int"


def run(spark, rows, widths, least=3):
    out = similarity_clusters(spark.createDataFrame(rows, ROWS), "m", "u", "v", spark.createDataFrame(widths, WIDTHS), "w", least)
    return out


def members(df):
    return sorted((r.cluster_id, r.m) for r in df.collect())


def test_clusters_across_cells(spark):
    rows = [(1, 1, -9.6, None), (2, 1, -10.2, None), (3, 1, -10.4, None), (4, 1, -30.0, None), (5, 1, -30.1, None), (6, 1, -29.9, None), (7, 1, 50.0, None)]
    rows += [(8, 2, v, None) for v in ()] + [(9, 2, 5.0, None), (10, 2, 5.0, None), (11, 2, 5.0, None), (12, 2, 5.1, None)]
    got = members(run(spark, rows, [(1, 1.0, 0), (1, 1.0, 1), (2, 0.0, 0)]))
    assert got == [(1, 1), (1, 2), (1, 3), (4, 4), (4, 5), (4, 6), (9, 9), (9, 10), (9, 11)]


def test_many_owners(spark):
    """Clusters of width below 2 and gaps above: same as cutting the sorted values at gaps."""
    rows, want, n = [], [], 0
    for u in range(60):
        for c in range(1 + u % 7):
            start = c * 7.3 + u * 0.17
            ids = list(range(n, n + 2 + (u + c) % 4))
            n += len(ids)
            rows += [(i, u, start + 1.9 * k / len(ids), None) for k, i in enumerate(ids)]
            if len(ids) >= 3:
                want += [(ids[0], i) for i in ids]
    assert members(run(spark, rows, [(u, 2.0, 0) for u in range(60)])) == sorted(want)


def test_dirty(spark):
    nan = float("nan")
    rows = [(1, 1, 1.0, None)] * 3 + [(2, 1, None, None), (3, 1, nan, None), (None, 1, 1.0, None), (4, None, 1.0, None), (5, 1, 1.1, None), (6, 1, 1.2, None), (7, 3, 1.0, None)]
    assert members(run(spark, rows, [(1, 1.0, 0), (None, 1.0, 0), (3, None, 0)])) == [(1, 1), (1, 5), (1, 6)]
    assert members(run(spark, [], [(1, 1.0, 0)])) == []


def test_typical(spark):
    rows = [(1, 1, 1.0, None), (2, 1, 1.5, None), (3, 1, 1.6, None), (4, 1, 2.0, None)]
    out = most_typical(run(spark, rows, [(1, 2.0, 0)]), "m", "u", k=2).orderBy("rank").collect()
    assert [(r["rank"], r["m"], r["size"]) for r in out] == [(1, 2, 4), (2, 3, 4)]


def test_chains_stay_whole(spark):
    """Runs of linked cells are one cluster whatever their length and however uneven their cells are filled; a gap parts them."""
    rows, want, n = [], [], 0
    runs = [[1] * 3, [10, 10, 10], [100, 10, 100], [60, 1, 60], [3] * 5, [1] * 20, [7, 1, 1, 30] * 5, [2] * 150]
    for u, counts in enumerate(runs):
        for part in range(2):  # the same run twice, a gap apart
            ids = []
            for c, k in enumerate(counts):
                ids += range(n, n + k)
                rows += [(n + i, u, (c + part * (len(counts) + 2)) * 0.99 + 0.001 * i / k, None) for i in range(k)]
                n += k
            want += [(ids[0], i) for i in ids]
    assert members(run(spark, rows, [(u, 1.0, 0) for u in range(len(runs))])) == sorted(want)


def test_a_run_over_many_blocks(spark, monkeypatch):
    """A pass that looks 16 cells ahead only still joins a run of 300 cells, in more passes."""
    from arrayloom.llm import spectral

    monkeypatch.setattr(spectral, "FARTHEST", 100)
    rows = [(i, 1, i * 0.9, None) for i in range(60)] + [(100 + i, 2, i * 5.0, None) for i in range(50)]
    assert members(run(spark, rows, [(1, 1.0, 0), (2, 1.0, 0)])) == [(0, i) for i in range(60)]


def test_extremes(spark):
    inf = float("inf")
    rows = [(1, 1, inf, None), (2, 1, inf, None), (3, 1, -inf, None), (4, 1, 1e300, None), (5, 1, 1e300, None), (6, 1, 1e300, None), (7, 1, -1e-20, None), (8, 1, 0.0, None), (9, 1, 1e-3, None)]
    rows += [(20 + i, 2, float(i // 3), None) for i in range(3000)]
    got = members(run(spark, rows, [(1, 1e-2, 0), (2, 0.0, 0)]))
    assert got == [(4, i) for i in (4, 5, 6)] + [(7, i) for i in (7, 8, 9)] + [(20 + i // 3 * 3, 20 + i) for i in range(3000)]
