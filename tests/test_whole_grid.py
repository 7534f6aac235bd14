import duckdb
import pytest

from arrayloom.functions import signal as S
from arrayloom.plans import trace_queries as T


@pytest.fixture(scope="module")
def uneven(tmp_path_factory):
    """Traces of 12 sensors on a 3 x 4 grid, of different lengths; the last channel has two frames only."""
    folder = tmp_path_factory.mktemp("uneven")
    duckdb.sql(f"""COPY (SELECT row_number() OVER () AS event_id, channel::BIGINT AS user_id, TIMESTAMP '2020-01-01' + INTERVAL (f) SECOND AS ts,
        ((channel * 7919 + f * 104729) % 211)::DOUBLE * CASE WHEN f % 8 = 1 THEN 9 ELSE 1 END - 90 AS value
        FROM (SELECT r + 10 * c AS channel, unnest(range(0, CASE WHEN c = 3 AND r = 2 THEN 2 ELSE 40 + r + 2 * c END)) AS f
              FROM range(3) a(r), range(4) b(c))) TO '{folder}/events.parquet' (FORMAT parquet)""")
    return str(folder)


def voxels(spark, folder):
    return {(r.channel % 10 + 1, r.channel // 10 + 1, r.frame): r.v for r in T.traces(spark, folder).collect()}


def boxes(x):
    out = {}
    for r, c, f in x:
        box = [x.get((r + i, c + j, f + k)) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
        if None not in box:
            out[r, c, f] = sum(v * v for v in box)
    return out


def test_every_whole_box_counts(spark, uneven):
    x = voxels(spark, uneven)
    assert T.grid_traces(spark, uneven).count() == len(x)
    got = {(r.row, r.col, r.frame): r.energy for r in T.stencil_energy(spark, uneven).collect()}
    want = boxes(x)
    assert max(f for _, _, f in want) > 2 and got == pytest.approx(want)


def test_active_box_of_uneven_traces(spark, uneven):
    grid = T.grid_traces(spark, uneven)
    z = {(r.row, r.col, r.frame): r.z for r in S.center_scale(grid, ["row", "col"]).collect()}
    n = {}
    for (r, c, _), e in boxes(z).items():
        n[r, c] = n.get((r, c), 0) + (e > 60)
    want = [p for p, k in n.items() if k >= 3]
    got = T.active_box(spark, uneven).collect()[0]
    assert got.sensors == len(want) and got.sensors > 0
    assert (got.min_row, got.max_row, got.min_col, got.max_col) == (min(r for r, _ in want), max(r for r, _ in want), min(c for _, c in want), max(c for _, c in want))
