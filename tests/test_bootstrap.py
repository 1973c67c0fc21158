import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions import bootstrap as B


def test_intervals_are_those_of_drawn_means(spark):
    """Samples of one to six strips, with missing values, against the draws themselves."""
    rng = np.random.default_rng(8)
    rows = [(s, "x", k, float(rng.normal())) for s in range(1, 7) for k in range(s)]
    rows += [(7, "x", k, v) for k, v in enumerate([1.0, float("nan"), None, 4.0])] + [(8, "x", 0, None), (9, "x", 3, 2.5)]
    got = {r["sample_id"]: (r["lo"], r["hi"]) for r in B.intervals(spark.createDataFrame(rows, "sample_id long, kpi string, strip int, value double").repartition(3), ["sample_id", "kpi"]).collect()}
    for s in range(1, 10):
        values = np.array([np.nan if v is None else v for i, _, _, v in rows if i == s])
        drawn = values[np.random.default_rng(B.SEED).integers(0, len(values), (B.RESAMPLES, len(values)))]
        held = np.isfinite(drawn)
        means = np.where(held, drawn, 0).sum(1)[held.any(1)] / held.sum(1)[held.any(1)]
        assert got[s] == ((None, None) if not len(means) else pytest.approx(tuple(np.percentile(means, [2.5, 97.5]))))
    assert B.intervals(spark.createDataFrame([], "sample_id long, kpi string, strip int, value double"), ["sample_id", "kpi"]).count() == 0


def test_stability_is_that_of_nearest_means(spark):
    rng = np.random.default_rng(9)
    kpis, batches = ["u", "v", "w"], [1, 2, 3]
    centre = {b: rng.normal(0, 1, 3) for b in batches}
    strips = {s: rng.normal(0, 1.5, (n, 3)) for s, n in enumerate((1, 2, 3, 5, 5))}
    vectors = spark.createDataFrame([(s, k, kpi, float(x)) for s, m in strips.items() for k, line in enumerate(m) for kpi, x in zip(kpis, line, strict=True)], "sample_id long, strip int, kpi string, x double")
    centres = spark.createDataFrame([(b, k, float(c)) for b, cs in centre.items() for k, c in zip(kpis, cs, strict=True)], "batch long, kpi string, c double")
    assigned = spark.createDataFrame([(s, 1 + s % 3) for s in strips], "sample_id long, assigned long")
    got = {r["sample_id"]: r["stability"] for r in B.stability(vectors, centres, assigned).collect()}
    for s, m in strips.items():
        means = m[np.random.default_rng(B.SEED).integers(0, len(m), (B.RESAMPLES, len(m)))].mean(axis=1)
        calls = np.argmin([((means - centre[b]) ** 2).sum(1) for b in batches], axis=0)
        assert got[s] == (calls == s % 3).mean()


def test_no_python_runs_in_tasks(spark):
    rows = spark.range(10).select("id", F.lit(0).alias("strip"), F.rand(1).alias("value"))
    plan = B.intervals(rows, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_too_many_strips(spark):
    rows = spark.range(100).select(F.lit(1).alias("k"), F.col("id").alias("strip"), F.rand(1).alias("value"))
    with pytest.raises(ValueError, match="strips"):
        B.intervals(rows, ["k"])


def test_equal_draws_are_one(spark):
    """The broadcast table has each different multiplicity once, with its number of resamples."""
    table = B.drawn(spark, 5).first()["drawn"]
    assert [len(table[n]) for n in range(1, 6)] == [len({tuple(m) for m in B.multiplicities(n)}) for n in range(1, 6)]
    assert len(table[5]) <= 126
    for n, held in table.items():
        assert sorted(list(d["times"]) for d in held for _ in range(d["n"])) == sorted(B.multiplicities(n))


@pytest.mark.parametrize("name", ["intervals", "stability"])
def test_means_are_dealt_over_all_partitions(spark, name):
    """Few bytes, but much work a row: adaptive execution must not join the partitions."""
    rows = spark.range(200).select(F.col("id").alias("sample_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("strip"), F.lit("k").alias("kpi"), F.rand(1).alias("x"))
    centres = spark.createDataFrame([(1, "k", 0.2), (2, "k", 0.7)], "batch long, kpi string, c double")
    assigned = spark.range(200).select(F.col("id").alias("sample_id"), F.lit(1).cast("long").alias("assigned"))
    out = B.intervals(rows.withColumnRenamed("x", "value"), ["sample_id"]) if name == "intervals" else B.stability(rows, centres, assigned)
    assert out.rdd.getNumPartitions() == 4
