"""Robust statistics as DataFrame expressions: medians, scales, and leave-one-out medians without a self-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Makes the median absolute deviation of normal data estimate its standard deviation.
MAD_FACTOR = 1.4826
SCALE_REL_FLOOR = 0.05
LEAST_SCALE = 1e-9


def finite(value: Column) -> Column:
    """The value, or null if it is NaN or infinite: statistics skip nulls."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def median(value: Column) -> Column:
    return F.percentile(value, F.lit(0.5))


def scale_of(mad: Column, within_se: Column, med: Column, abs_floor: Column, rel_floor: float = SCALE_REL_FLOOR) -> Column:
    """The largest of spread, measurement error, and a floor relative to the median or absolute."""
    scale = F.greatest(mad, F.coalesce(within_se, F.lit(0.0)), rel_floor * F.abs(med), F.coalesce(abs_floor, F.lit(0.0)))
    return F.when(scale > 0, scale).otherwise(F.lit(LEAST_SCALE))


def robust_stats(rows: DataFrame, keys: list[str], value: str = "value", se: str | None = "se", abs_floor: str | None = None, rel_floor: float = SCALE_REL_FLOOR) -> DataFrame:
    """`keys, n, med, mad, within_se, scale, min, max` of the finite values of each group."""
    floor = F.first(abs_floor) if abs_floor else F.lit(None).cast("double")
    errors = median(finite(F.col(se))) if se else F.lit(None).cast("double")
    clean = rows.withColumn("__v", finite(F.col(value)))
    centre = clean.groupBy(*keys).agg(
        F.count("__v").alias("n"), median(F.col("__v")).alias("med"), F.coalesce(errors, F.lit(0.0)).alias("within_se"), F.min("__v").alias("min"), F.max("__v").alias("max"), floor.alias("__floor")
    )
    spread = clean.join(F.broadcast(centre.select(*keys, "med")) if not keys else centre.select(*keys, "med"), keys).groupBy(*keys).agg((MAD_FACTOR * median(F.abs(F.col("__v") - F.col("med")))).alias("mad"))
    out = centre.join(spread, keys, "left")
    scale = F.when(F.col("n") > 0, scale_of(F.col("mad"), F.col("within_se"), F.col("med"), F.col("__floor"), rel_floor))
    return out.select(*keys, "n", "med", "mad", "within_se", scale.alias("scale"), "min", "max")


def loo_median(rows: DataFrame, keys: list[str], value: str, out: str, order: str) -> DataFrame:
    """Adds `out`: the median of the group's values without the row's own.

    Leaving one value out of a sorted list moves the median to one of three places next to the middle, which
    depend on the row's rank alone. So one sort by group replaces the join of every row with all others. `order`
    breaks ties; null values have no rank, and their rows get the median of all others."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumns({"__rank": F.when(F.col(value).isNotNull(), F.row_number().over(w.orderBy(F.col(value).asc_nulls_last(), order))), "__n": F.count(value).over(w)})

    def at(rank: Column) -> Column:
        return F.max(F.when(F.col("__rank") == rank, F.col(value))).over(w)

    n, r = F.col("__n"), F.col("__rank")
    half = F.floor(n / 2)
    # even n: one of the two middle values is left; odd n: the mean of two of the three middle values
    even = F.when(r <= half, F.col("__b")).otherwise(F.col("__a"))
    odd = F.when(r <= half, (F.col("__b") + F.col("__c")) / 2).when(r == half + 1, (F.col("__a") + F.col("__c")) / 2).otherwise((F.col("__a") + F.col("__b")) / 2)
    whole = F.when(n % 2 == 1, F.col("__b")).otherwise((F.col("__a") + F.col("__b")) / 2)
    placed = ranked.withColumns({"__a": at(half), "__b": at(half + 1), "__c": at(half + 2)})
    result = F.when(r.isNull(), whole).when(n < 2, F.lit(None).cast("double")).when(n % 2 == 0, even).otherwise(odd)
    return placed.withColumn(out, result).drop("__rank", "__n", "__a", "__b", "__c")


def interpolate(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return y0 + F.coalesce(F.try_divide(x - x0, x1 - x0), F.lit(0.0)) * (y1 - y0)


def weighted_quantiles(rows: DataFrame, keys: list[str], value: str, weight: str, quantiles: list[float], by_item: bool = False) -> DataFrame:
    """`keys, q, value`: quantiles of the cumulative weight share, linear between data points, clamped below the
    first point. Equal values are one step, so ties need no order; with `by_item` every row is a step of its own, which
    takes a weight that depends on the value alone."""
    steps = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("__w"), F.avg(weight).alias("__one"))
    ordered = Window.partitionBy(*keys).orderBy(value)
    share = F.sum("__w").over(ordered) / F.sum("__w").over(Window.partitionBy(*keys))
    first_share = F.col("__w") / F.sum("__w").over(Window.partitionBy(*keys))
    curve = steps.withColumns({"__share": share, "__own": first_share}).withColumns({"__before": F.lag("__share").over(ordered), "__last": F.lag(value).over(ordered)})
    spread = curve.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    here = (F.col("q") <= F.col("__share")) & (F.col("__before").isNull() | (F.col("q") > F.col("__before")))
    reached = F.col("__before") + F.col("__own") * F.col("__one") / F.col("__w") if by_item else F.col("__share")
    between = interpolate(F.col("q"), F.col("__before"), F.col("__last"), reached, F.col(value))
    got = F.when(F.col("__before").isNull() | (F.col("q") > reached), F.col(value).cast("double")).otherwise(between)
    return spread.where(here).select(*keys, "q", got.alias("value"))


def average_ranks(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Ranks from 1 within each group; ties share their mean rank."""
    ordered = Window.partitionBy(*keys).orderBy(value)
    ties = Window.partitionBy(*keys, value)
    return rows.withColumn(out, F.rank().over(ordered) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)
