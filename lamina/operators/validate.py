"""Validation and regression: effect sizes, rank tests, nested leave-one-out, confusion, scoring, snapshot diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.robust import average_ranks, finite, median, robust_stats
from lamina.operators import assign as A
from lamina.operators.baseline import loo_stats
from lamina.operators.facts import BASELINE, weight

#: Tolerances of a snapshot, in baseline scales and relative for fractions.
SNAPSHOT_SCALE, SNAPSHOT_RELATIVE = 0.1, 0.01


def effect_sizes(facts: DataFrame, floors: Column | None = None) -> DataFrame:
    """`a, b, kpi, median_a, median_b, effect` of each pair of batches: the distance of the medians in pooled scales."""
    stats = robust_stats(facts, ["batch", "kpi"]).where("n > 0").select("batch", "kpi", "med", "scale")
    a = stats.select(F.col("batch").alias("a"), "kpi", F.col("med").alias("median_a"), F.col("scale").alias("sa"))
    b = stats.select(F.col("batch").alias("b"), "kpi", F.col("med").alias("median_b"), F.col("scale").alias("sb"))
    pairs = a.join(F.broadcast(b), "kpi").where("a < b")  # batches times indicators
    pooled = F.sqrt((F.col("sa") ** 2 + F.col("sb") ** 2) / 2)
    return pairs.select("a", "b", "kpi", "median_a", "median_b", F.try_divide(F.abs(F.col("median_a") - F.col("median_b")), pooled).alias("effect"))


def spearman(pairs: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """`keys, n, rho`: correlation of average ranks, of the rows that have both values."""
    both = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_ranks(average_ranks(both, keys, x, "__x"), keys, y, "__y")
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("__x", "__y").alias("rho"))


def kruskal(facts: DataFrame) -> DataFrame:
    """`kpi, n, h, p`: the rank test of equal location over batches, corrected for ties. p holds for three batches,
    where the distribution with two degrees of freedom has a closed form; otherwise it is null."""
    clean = facts.where(F.col("value").isNotNull())
    ranked = average_ranks(clean, ["kpi"], "value", "rank")
    ties = clean.groupBy("kpi", "value").count().groupBy("kpi").agg(F.sum(F.col("count").cast("double") ** 3 - F.col("count")).alias("ties"))
    groups = ranked.groupBy("kpi", "batch").agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("m")).groupBy("kpi").agg(F.sum(F.col("r") ** 2 / F.col("m")).alias("s"), F.sum("m").alias("n"), F.count(F.lit(1)).alias("k"))
    n = F.col("n").cast("double")
    raw = 12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    h = F.try_divide(raw, 1 - F.col("ties") / (n**3 - n))
    return groups.join(ties, "kpi").select("kpi", "n", h.alias("h"), F.when(F.col("k") == 3, F.exp(-h / 2)).alias("p"))


def shared_range(facts: DataFrame, gate: DataFrame, batches: list[int]) -> DataFrame:
    """`facts` of the batches, of samples whose gate value (sample_id, batch, value) lies in the range that all share."""
    some = gate.where(F.col("batch").isin(batches))
    ends = some.groupBy("batch").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    inside = some.crossJoin(F.broadcast(ends)).where("value BETWEEN lo AND hi").select("sample_id")  # one row
    return facts.where(F.col("batch").isin(batches)).join(inside, "sample_id")


def nested_loio(facts: DataFrame, delta: float = 0.0, temperature: float = 2.0, batch: int = BASELINE) -> DataFrame:
    """`sample_id, batch, candidate, p`: chances of every sample from baseline statistics, features and centroids
    that are all fitted without it.

    Leaving out a sample of another batch leaves the statistics alone, so those folds share one feature table and
    leave-one-out medians; samples that lack an indicator don't enter its centroids. Leaving out a baseline sample gives one of few (median, scale) pairs an indicator; as
    features are linear in the values, batch medians of values carry over to medians of features."""
    clean = facts.withColumn("value", finite(F.col("value")))
    others = clean.where(F.col("batch") != batch)
    base = robust_stats(clean.where(F.col("batch") == batch).withColumn("floor", _floor()), ["kpi"], abs_floor="floor").select("kpi", "med", "scale")
    folds = loo_stats(clean, batch).select("sample_id", "batch", "kpi", "value", "med", "scale")
    folds = folds.unionByName(others.join(F.broadcast(base), "kpi").select("sample_id", "batch", "kpi", "value", "med", "scale"))
    # medians of raw values by batch, the own one without the sample
    whole = clean.groupBy("batch", "kpi").agg(median(F.col("value")).alias("m"), F.count("value").alias("n"))
    table = whole.groupBy("kpi").agg(F.collect_list(F.struct(F.col("batch").alias("candidate"), "m", "n")).alias("table"))
    own = A.loo_median(clean, ["batch", "kpi"], "value", "own", "sample_id").select("sample_id", "kpi", "own")
    both = folds.join(own, ["sample_id", "kpi"]).join(F.broadcast(table), "kpi")

    def feature(value: Column) -> Column:
        return F.coalesce((value - F.col("med")) / F.col("scale") * weight(F.col("kpi")), F.lit(0.0))

    # a batch without any other sample is no candidate
    left = F.filter("table", lambda t: (t["candidate"] != F.col("batch")) | (t["n"] > 1))
    refitted = F.transform(left, lambda t: F.struct(t["candidate"].alias("candidate"), feature(F.when(t["candidate"] == F.col("batch"), F.col("own")).otherwise(t["m"])).alias("c")))
    spread = both.select("sample_id", "batch", "kpi", feature(F.col("value")).alias("x"), refitted.alias("table")).withColumn("centre", A._middle(F.col("table")["c"]))
    wide = spread.select("sample_id", "batch", "x", "centre", F.explode("table").alias("t"))
    off = F.col("x") - A._shrink(F.col("t.c"), F.col("centre"), F.lit(float(delta)))
    measured = wide.groupBy("sample_id", "batch", F.col("t.candidate").alias("candidate")).agg(F.sqrt(F.sum(off**2)).alias("d"))
    return A.softmax(measured, F.lit(float(temperature)), ["sample_id"]).select("sample_id", "batch", "candidate", "p")


def _floor() -> Column:
    from lamina.operators.facts import abs_floor

    return abs_floor(F.col("kpi"))


def confusion(chances: DataFrame) -> DataFrame:
    """`batch, candidate, n`: true and predicted batches."""
    return A.best(chances, ["sample_id"]).groupBy("batch", "candidate").agg(F.count(F.lit(1)).alias("n"))


def likelihood(chances: DataFrame) -> DataFrame:
    """`n, nll, brier, accuracy, majority`: quality of the chances, beside the share of the largest batch."""
    hit = (F.col("candidate") == F.col("batch")).cast("double")
    top = F.max(F.struct(F.round("p", A.P_DIGITS).alias("p"), (-F.col("candidate")).alias("c")))
    each = chances.groupBy("sample_id", "batch").agg(F.sum(F.col("p") * hit).alias("pt"), F.sum((F.col("p") - hit) ** 2).alias("b"), top.alias("top"))
    largest = each.groupBy("batch").count().agg(F.max("count").alias("size"))
    size = F.max(F.col("size"))
    return each.crossJoin(F.broadcast(largest)).agg(  # one row
        F.count(F.lit(1)).alias("n"),
        F.avg(-F.log(F.greatest(F.col("pt"), F.lit(A.LEAST_P)))).alias("nll"),
        F.avg("b").alias("brier"),
        F.avg((-F.col("top.c") == F.col("batch")).cast("double")).alias("accuracy"),
        (size / F.count(F.lit(1))).alias("majority"),
    )


def snapshot_diff(old: DataFrame, new: DataFrame, stats: DataFrame, fraction: Column) -> DataFrame:
    """`sample_id, kpi, old, new, delta_scale, rel, changed` of the samples in both; a value that exactly one side
    lacks is a change of infinite size, shown as null."""
    a = old.select("sample_id", "kpi", finite(F.col("value")).alias("old"))
    b = new.select("sample_id", "kpi", finite(F.col("value")).alias("new"))
    both = a.join(b, ["sample_id", "kpi"]).join(F.broadcast(stats.select("kpi", "scale")), "kpi", "left").where("old IS NOT NULL OR new IS NOT NULL")
    size = F.abs(F.col("new") - F.col("old"))
    scaled = F.try_divide(size, F.col("scale"))
    rel = F.when(size == 0, 0.0).otherwise(F.try_divide(size, F.abs("old")))
    beyond = (scaled >= SNAPSHOT_SCALE) | (fraction & (F.coalesce(rel, F.lit(float("inf"))) >= SNAPSHOT_RELATIVE))
    one_sided = F.col("old").isNull() | F.col("new").isNull()
    return both.select("sample_id", "kpi", "old", "new", scaled.alias("delta_scale"), rel.alias("rel"), (one_sided | F.coalesce(beyond, F.lit(False))).alias("changed"))


def membership(old: DataFrame, new: DataFrame) -> DataFrame:
    """`sample_id, status`: samples that only one snapshot has."""
    a, b = old.select("sample_id").distinct(), new.select("sample_id").distinct()
    return b.join(a, "sample_id", "left_anti").withColumn("status", F.lit("new")).unionByName(a.join(b, "sample_id", "left_anti").withColumn("status", F.lit("missing")))


def plausibility(facts: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """`sample_id, batch, kpi, value, lo, hi, ok` of the indicators with a range; a missing value is not ok."""
    bounds = F.create_map(*[F.lit(x) for k, (lo, hi) in ranges.items() for x in (k, f"{lo}:{hi}")])
    some = facts.where(F.col("kpi").isin(list(ranges))).withColumn("__b", F.split(bounds[F.col("kpi")], ":"))
    lo, hi = F.col("__b")[0].cast("double"), F.col("__b")[1].cast("double")
    return some.select("sample_id", "batch", "kpi", "value", lo.alias("lo"), hi.alias("hi"), F.coalesce(finite(F.col("value")).between(lo, hi), F.lit(False)).alias("ok"))


def score_predictions(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """`sample_id, truth, assigned, p_truth, correct` of predictions (sample_id, assigned, novel, chances map) with a
    known truth; truth 'none' is met by the novelty flag."""
    both = predictions.join(truth, "sample_id")
    hit = F.when(F.col("truth") == "none", F.col("novel")).otherwise(F.col("assigned") == F.col("truth"))
    return both.select("sample_id", "truth", "assigned", F.col("chances")[F.col("truth")].alias("p_truth"), hit.alias("correct"))
