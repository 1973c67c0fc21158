"""Comparison of samples with a baseline batch: statistics, z-scores, scores, verdicts, gates and alarms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.ranks import count_beside
from lamina.functions.robust import MAD_FACTOR, finite, loo_median, robust_stats, scale_of
from lamina.operators.facts import BASELINE, abs_floor

#: Limits of the verdict zones.
INVESTIGATE_Z = 8.0
REJECT_Z = 12.8
WATCH_Z = 6.4
MULTI_N = 3
WATCH_N = 2
GATE_Z = 4.0
POISSON_SD = 3.0
TOP = 3


def baseline(facts: DataFrame, batch: int | str = BASELINE, floors: bool = True, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Robust statistics of each indicator over the baseline batch, for each group of `by` on its own."""
    own = facts.where(F.col("batch") == batch).withColumn("floor", abs_floor(F.col("kpi")) if floors else F.lit(0.0))
    return robust_stats(own, [*by, "kpi"], se="se" if "se" in facts.columns else None, abs_floor="floor")


def zscores(facts: DataFrame, stats: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """`facts` with `z`; null if value or median is missing. Statistics are a row for each indicator, and group of `by`."""
    own = stats.select(*by, "kpi", "med", "scale")
    z = F.try_divide(finite(F.col("value")) - F.col("med"), F.col("scale"))
    return facts.join(own if by else F.broadcast(own), [*by, "kpi"], "left").withColumn("z", z)


def top_score(scored: DataFrame, keys: list[str] = ["sample_id", "batch"]) -> DataFrame:  # noqa: B006
    """`keys, score`: mean of the TOP largest absolute z-scores. An array of the indicators of one sample is
    small, so no sort beyond the grouping is needed."""
    top = F.slice(F.sort_array(F.collect_list(F.abs("z")), asc=False), 1, TOP)
    total = F.aggregate("top", F.lit(0.0), lambda a, x: a + x)
    return scored.groupBy(*keys).agg(top.alias("top")).select(*keys, F.try_divide(total, F.size("top").cast("double")).alias("score"))


def verdicts(scored: DataFrame, alarms: DataFrame | None = None, by: list[str] = []) -> DataFrame:  # noqa: B006
    """`by, sample_id, batch, n_reject, n_investigate, n_watch, n_alarms, decision`."""

    def beyond(limit: float) -> Column:
        return F.count(F.when(F.abs("z") > limit, 1))

    out = scored.groupBy(*by, "sample_id", "batch").agg(beyond(REJECT_Z).alias("n_reject"), beyond(INVESTIGATE_Z).alias("n_investigate"), beyond(WATCH_Z).alias("n_watch"))
    if alarms is not None:
        out = out.join(alarms.groupBy("sample_id").agg(F.count(F.when(F.col("alarm"), 1)).alias("n_alarms")), "sample_id", "left")
    else:
        out = out.withColumn("n_alarms", F.lit(0).cast("long"))
    out = out.withColumn("n_alarms", F.coalesce("n_alarms", F.lit(0)).cast("long"))
    bad = (F.col("n_reject") > 0) | (F.col("n_investigate") >= MULTI_N) | (F.col("n_alarms") > 0)
    odd = (F.col("n_investigate") > 0) | (F.col("n_watch") >= WATCH_N)
    return out.withColumn("decision", F.when(bad, "REJECT").when(odd, "INVESTIGATE").otherwise("ACCEPT"))


def defect_alarms(counts: DataFrame, batch: int = BASELINE) -> DataFrame:
    """`sample_id, kpi, observed, expected, alarm` of `counts` (sample_id, batch, kpi, observed, area): the
    baseline's largest count, scaled by area, exceeded by more than POISSON_SD Poisson deviations."""
    own = counts.where(F.col("batch") == batch)
    most = own.groupBy("kpi").agg(F.max("observed").alias("most"))
    area = own.select("sample_id", "area").distinct().agg(F.percentile("area", F.lit(0.5)).alias("mid"))
    both = counts.join(F.broadcast(most), "kpi").crossJoin(F.broadcast(area))  # one row
    factor = F.when(F.col("mid") > 0, F.col("area") / F.col("mid")).otherwise(1.0)
    expected = F.col("most") * factor
    return both.select("sample_id", "kpi", "observed", expected.alias("expected"), (F.col("observed") > expected + POISSON_SD * F.sqrt(F.greatest(expected, F.lit(1.0)))).alias("alarm"))


def gate_status(scored: DataFrame) -> DataFrame:
    """`sample_id, n_flags, status` from the z-scores of acquisition gates."""
    flags = F.count(F.when(F.abs("z") > GATE_Z, 1))
    return scored.groupBy("sample_id").agg(flags.alias("n_flags")).withColumn("status", F.when(F.col("n_flags") > 0, "caution").otherwise("ok"))


def loo_stats(facts: DataFrame, batch: int = BASELINE) -> DataFrame:
    """For each baseline sample and indicator, `med` and `scale` of the baseline without that sample.

    The median without one value is one of at most three; for each of those the absolute deviations are ranked
    once, so the cost is a few sorts instead of a join of all pairs."""
    own = facts.where(F.col("batch") == batch).withColumn("value", finite(F.col("value")))
    left = loo_median(own, ["kpi"], "value", "med", "sample_id")
    left = loo_median(left, ["kpi"], "se", "wse", "sample_id")
    centres = left.select("kpi", F.col("med").alias("centre")).where("centre IS NOT NULL").distinct()  # up to three an indicator
    deviations = own.select("kpi", "sample_id", "value").join(centres, "kpi").withColumn("dev", F.abs(F.col("value") - F.col("centre")))
    spread = loo_median(deviations, ["kpi", "centre"], "dev", "loo_dev", "sample_id").select("kpi", "sample_id", F.col("centre").alias("med"), "loo_dev")
    out = left.join(spread, ["kpi", "sample_id", "med"], "left")
    scale = scale_of(MAD_FACTOR * F.col("loo_dev"), F.col("wse"), F.col("med"), abs_floor(F.col("kpi")))
    return out.select("sample_id", "batch", "kpi", "value", "med", F.when(F.col("med").isNotNull(), scale).alias("scale"))


def loo_scores(facts: DataFrame, batch: int = BASELINE) -> DataFrame:
    """`sample_id, score`: each baseline sample against the baseline without it."""
    scored = loo_stats(facts, batch).withColumn("z", F.try_divide(F.col("value") - F.col("med"), F.col("scale")))
    return top_score(scored, ["sample_id"])


def conformal(scores: DataFrame, reference: DataFrame) -> DataFrame:
    """`sample_id, batch, score, p_rank, p_floor`: share of reference scores, itself included, that are at least
    as large."""
    own = count_beside(scores.select("sample_id", "batch", "score"), reference, "score", above=True)
    return own.select("sample_id", "batch", "score", ((1 + F.col("n_beside")) / (F.col("n_reference") + 1)).alias("p_rank"), (1 / (F.col("n_reference") + 1)).alias("p_floor"))
