import duckdb

from arrayloom.plans import model_queries as M


def test_all_touching_sensors_are_scored(spark, tmp_path):
    duckdb.sql(f"""COPY (SELECT row_number() OVER () AS event_id, (r + 10 * c)::BIGINT AS user_id, TIMESTAMP '2020-01-01' + INTERVAL (f) SECOND AS ts,
        (((r + 10 * c) * 7919 + f * 104729 + f * f * r) % 211)::DOUBLE - 90 AS value FROM range(7, 10) a(r), range(3) b(c), range(30) t(f)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    got = M.channel_crosstalk(spark, str(tmp_path)).collect()
    places = [(r + 10 * c, r, c) for r in range(7, 10) for c in range(3)]
    want = [(a, b) for a, r, c in places for b, s, d in places if a < b and abs(r - s) <= 1 and abs(c - d) <= 1]
    assert sorted((x.a, x.b) for x in got) == sorted(want) and len(want) == 20 and all(x.ratio is not None for x in got)
