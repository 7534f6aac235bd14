import random

import duckdb

from arrayloom.plans import relation_queries as R

FILES = ["x_run1", "x_run2", "x_run3", "x_run10"]


def events(folder):
    """Events of four files; the third one shares no sensor with the others."""
    rng = random.Random(7)
    rows = [(i, FILES[i % 4], rng.randrange(1, 6) + 50 * (i % 4 == 2), rng.randrange(1, 4)) for i in range(60)]
    rows += [(60, FILES[0], None, 2), (61, FILES[1], 3, None), rows[0]]
    values = ", ".join(str(tuple("NULL" if v is None else v for v in r)).replace("'NULL'", "NULL") for r in rows)
    duckdb.sql(f"""COPY (SELECT event_id::BIGINT AS event_id, filename, boss_row::INT AS boss_row, boss_column::INT AS boss_column, event_id::DOUBLE AS time
        FROM (VALUES {values}) t(event_id, filename, boss_row, boss_column)) TO '{folder}/basic_events.parquet' (FORMAT parquet)""")
    return sorted({r for r in rows if None not in r})


def pairs():
    return [(a, b) for a in FILES for b in FILES if a < b]


def test_sets_of_every_two_runs(spark, tmp_path):
    own = {}
    for _, f, r, c in events(tmp_path):
        own.setdefault(f, set()).add((r, c))
    got = {(r.file_a, r.file_b, r.part): r.n for r in R.run_sets(spark, str(tmp_path)).collect()}
    want = {}
    for a, b in pairs():
        p, q = own[a], own[b]
        want |= {(a, b, "both"): len(p & q), (a, b, "first_only"): len(p - q), (a, b, "either"): len(p | q)}
    assert got == want and 0 in got.values()


def test_overlaps_of_every_two_runs(spark, tmp_path, monkeypatch):
    rows, rng = events(tmp_path), random.Random(8)
    took = {(e, rng.randrange(1, 8), rng.randrange(1, 3)) for e, *_ in rows for _ in range(3)}
    sensors = spark.createDataFrame(sorted(took), "event_id long, sensor_row int, sensor_col int")
    monkeypatch.setattr(R, "_took_part", lambda s, d, *by: R._once(s, d, *by).join(sensors, "event_id"))
    own = {}
    for e, f, r, c in rows:
        own.setdefault((f, (c - 1) * 128 + r), set()).update((q, p) for i, p, q in took if i == e)
    got = {(r.file_a, r.a, r.file_b, r.b): (r.common, r.overlap) for r in R.roi_overlap_two_lists(spark, str(tmp_path)).collect()}
    want = {(f, a, g, b): (len(x & y), round(len(x & y) / min(len(x), len(y)), 6)) for (f, a), x in own.items() for (g, b), y in own.items() if f < g and x & y}
    assert got == want and len({(f, g) for f, _, g, _ in got}) == 6
