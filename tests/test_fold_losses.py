"""The array kernel of the nested validation, and its query on more samples than states times samples fit as rows."""

import math

import numpy as np
import pytest

from lamina.operators import fold_losses as K


@pytest.mark.parametrize("n", range(1, 12))
def test_median_without_two_places(n):
    values = [float(k * k) for k in range(n)]
    p0 = (n - 1) // 2
    mid = [values[p - 1] if 1 <= p <= n else None for p in range(p0, p0 + 4)]
    table = K.medians_without(n, p0, mid)

    def cut(rank):
        return max(min(rank, p0 + 4), p0 - 1) - p0 + 1

    for a in range(1, n + 1):
        for b in [*range(1, n + 1), None]:
            if a == b:
                continue
            left = [v for k, v in enumerate(values, 1) if k not in (a, b)]
            got = table[cut(a)][K.NONE if b is None else cut(b)]
            if cut(a) == (None if b is None else cut(b)):
                # Ranks beyond the places are alike, so what is left of the middle is too.
                assert left == [] or got == np.median(left), (n, a, b)
            else:
                assert math.isnan(got) if not left else got == np.median(left), (n, a, b)


def test_losses_of_a_sample_at_its_centroid():
    """Two batches, one indicator: a sample on its own centroid, the other one two away."""
    tables = [[[[0.0] * 7] * 7], [[[2.0] * 7] * 7]]
    one = np.ones((1, 1))
    states = [0 * one, one, one, np.full((1, 1), K.NONE), np.array([[[0.0, 2.0]]])]
    got = K.losses(np.zeros((1, 1)), np.full((1, 1), K.NONE), states, np.array([0]), 0, tables, np.array([0.0, 1.0]), [1.0], 1e-3)
    np.testing.assert_allclose(got[0, :, 0], [math.log(1 + math.exp(-2)), math.log(2)])


def test_no_row_for_a_pair(spark, tmp_path, monkeypatch):
    """Losses are made from blocks: the judging step reads far fewer rows than states times samples."""
    from lamina.operators import nested as N

    seen = []
    made = K.judge

    def judge(*args):
        seen.append(args)
        return made(*args)

    monkeypatch.setattr(N.K, "judge", judge)
    rows = [(i, i % 2 + 2, "qty_mean", float((i * 37) % 101), 0.1) for i in range(60)]
    facts = spark.createDataFrame(rows, "sample_id long, batch long, kpi string, value double, se double")
    strips = spark.createDataFrame([(i, s, "qty_mean", float(i + s)) for i in range(60) for s in range(2)], "sample_id long, strip long, kpi string, value double")
    assert N.nested_tuning(facts, strips).count() == 60
    assert len(seen) == 1
