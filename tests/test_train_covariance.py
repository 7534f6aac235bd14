from arrayloom.operators import decompose as D
from arrayloom.plans import model_queries as M
from test_trains import FIRST, LAST, folder  # noqa: F401


def test_equal_frames_are_one_row(spark, folder, monkeypatch):  # noqa: F811
    """All frames count, but those without a spike stand in one row."""
    read = []
    real = D.covariances
    monkeypatch.setattr(D, "covariances", lambda df, *rest: read.append(df.collect()) or real(df, *rest))
    got = sorted((r.roi_id, r.i, r.j, r.c) for r in M.source_covariance(spark, folder[0]).collect())
    assert got == [(r, i, j, float(i == j)) for r in (1, 2) for i, j in ((0, 0), (0, 1), (1, 1))]
    assert len(read[0]) < 500 and sum(r.n for r in read[0]) == 2 * (LAST - FIRST + 1)
