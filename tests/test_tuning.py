"""The tuning's distances are added up where a sample's rows are dealt to."""

import numpy as np
import pytest

from lamina.operators import assign as A


def rows_of(spark):
    rng = np.random.default_rng(6)
    return spark.createDataFrame([(s, s % 3, k, float(rng.normal(s % 3))) for s in range(30) for k in range(4)], "sample_id long, batch long, kpi long, x double")


def test_nothing_is_shuffled_after_it_grew(spark):
    rows = rows_of(spark)
    measured = A.loo_distances(rows, A.SHRINKAGES)
    plan = measured._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.rindex("Generate")]
    assert measured.rdd.getNumPartitions() == 4
    assert "Window" not in (whole := A.tuning(rows)._jdf.queryExecution().executedPlan().toString())[: whole.rindex("Generate")]


def test_tuning_is_that_of_refitted_centroids(spark):
    rows = rows_of(spark)
    x, batch = np.zeros((30, 4)), np.arange(30) % 3
    for r in rows.collect():
        x[r["sample_id"], r["kpi"]] = r["x"]
    got = {(r["delta"], r["temperature"]): (r["nll"], r["accuracy"]) for r in A.tuning(rows).collect()}
    assert len(got) == len(A.SHRINKAGES) * len(A.TEMPERATURES)
    for (delta, t), found in got.items():
        losses, right = [], []
        for s in range(30):
            raw = np.array([np.median(x[(batch == b) & (np.arange(30) != s)], axis=0) for b in range(3)])
            centre = np.median(raw, axis=0)
            c = centre + np.sign(raw - centre) * np.maximum(np.abs(raw - centre) - delta, 0)
            d2 = ((x[s] - c) ** 2).sum(1)
            p = np.exp((d2.min() - d2) / (2 * t))
            p /= p.sum()
            losses.append(-np.log(max(p[batch[s]], A.LEAST_P)))
            right.append(np.argmax(np.round(p, A.P_DIGITS)) == batch[s])
        assert found == (pytest.approx(np.mean(losses)), pytest.approx(np.mean(right)))
