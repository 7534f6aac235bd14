from arrayloom.operators import units as U


def test_a_repeated_spike_counts_once_and_spellings_are_one(spark):
    rows = [(5, "N1", 9, 9), (2, " n1\t", 3, 4), (2, " n1\t", 3, 4), (7, "n1", 8, 8), (1, None, 1, 1), (3, "N2", 6, 7), (3, "N2", 6, 7)]
    df = spark.createDataFrame(rows, "gt_id long, neuron string, sensor_row int, sensor_col int")
    got = sorted(tuple(r) for r in U.first_places(df, "neuron", "gt_id").collect())
    assert got == [("n1", 3, 4, 3), ("n2", 6, 7, 1)]
