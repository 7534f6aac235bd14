import math

from arrayloom.sources.recording import read_box, sampling_rate, write_traces
from arrayloom.sources.text_tables import read_events, read_true_spikes, write_result
from arrayloom.streaming.counts import once, run_to_table, windowed_counts


def test_box(spark, tmp_path):
    rows = [("r", r, c, f, float(r * 100 + c * 10 + f)) for r in range(6) for c in range(6) for f in range(8)]
    path = str(tmp_path / "t")
    write_traces(spark.createDataFrame(rows, "rec_id string, row int, col int, frame long, v double"), path, tile=4, chunk=5)
    box = read_box(spark, path, "r", (1, 4), (3, 3), (4, 6), "NCA", tile=4, chunk=5)
    assert sorted(tuple(x) for x in box.collect()) == sorted(("r", r, c, f, v * 1000) for _, r, c, f, v in rows if 1 <= r <= 4 and c == 3 and 4 <= f <= 6)
    plan = box._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "GreaterThanOrEqual(row,1)" in plan
    sr = sampling_rate(spark.createDataFrame([("r", i / 11.7) for i in range(100)], "rec_id string, t_ms double")).collect()[0]
    assert math.isclose(sr.sr_khz, 100 / (99 / 11.7))


def test_text(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("filename\tplace\ttime\tamplitude\tboss_column\tboss_row\tsensors\na\t1\t1.5\t-80\t3\t7\t(3,7)(4,7)\n")
    e = read_events(spark, str(tmp_path / "e.tsv")).collect()
    assert (e[0].time, e[0].boss_column, e[0].sensors) == (1.5, 3, "(3,7)(4,7)")
    (tmp_path / "s.tsv").write_text("a\tb\tc\td\te\tf\tg\nx\tN1\t2.5\t0\t4\t5\t0\n")
    assert tuple(read_true_spikes(spark, str(tmp_path / "s.tsv")).collect()[0]) == ("N1", 2.5, 4, 5)
    write_result(spark.createDataFrame([("50%\\", 1.23456)], "filename string, time double"), str(tmp_path / "out"), 4)
    back = spark.read.csv(str(tmp_path / "out"), sep="\t", header=True).collect()
    assert back[0].time == "1.2346" and back[0].filename.startswith("50%")


def test_stream(spark, tmp_path):
    rows = [(1, "2030-01-01 00:00:00"), (2, "2030-01-01 00:10:00"), (1, "2030-01-01 05:00:00"), (3, "2030-01-01 06:00:00")]
    df = spark.createDataFrame(rows, "k long, at string").selectExpr("k", "CAST(at AS timestamp) AS at")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert sorted(r.k for r in run_to_table(once(stream, "k", "at", "1 day").select("k")).collect()) == [1, 2, 3]
    counts = windowed_counts(df, [], "at", "1 hour").collect()
    assert sorted(r.n for r in counts) == [1, 1, 2]
