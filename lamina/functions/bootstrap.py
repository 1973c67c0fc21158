"""Bootstrap over the few strips of a sample, without a draw in any task.

Which strips a resample has depends on the seed and the number of strips alone, and a mean needs no more than how often each
strip was drawn. So the multiplicities of all resamples are one small row, RESAMPLES times the square of the largest number of
strips at most, that is broadcast; a sample's means are weighted sums over its array of strips. Resamples that drew the same
strips equally often have the same mean, so it is made once and counts as often as it was drawn: of 1000 resamples of five
strips no more than 126 differ.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.tables import spread, stored

RESAMPLES, SEED = 1000, 0
#: Strips are few by definition; more than this would make the row of multiplicities large.
MOST_STRIPS = 64


def multiplicities(n: int, resamples: int = RESAMPLES, seed: int = SEED) -> list[list[int]]:
    """How often each of `n` strips is in each resample."""
    picks = np.random.default_rng(seed).integers(0, n, (resamples, n))
    out = np.zeros((resamples, n), np.int64)
    np.add.at(out, (np.arange(resamples)[:, None], picks), 1)
    return out.tolist()


def draws(n: int, resamples: int = RESAMPLES, seed: int = SEED) -> list[tuple[list[int], int]]:
    """The different multiplicities of `n` strips, and how many resamples have them."""
    each, counts = np.unique(np.array(multiplicities(n, resamples, seed)).reshape(resamples, n), axis=0, return_counts=True)
    return list(zip(each.tolist(), counts.tolist(), strict=True))


def drawn(spark: SparkSession, most: int, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """One row: `drawn`, a map from the number of strips to the different multiplicities and their numbers of resamples."""
    if most > MOST_STRIPS:
        raise ValueError(f"{most} strips in a sample, {MOST_STRIPS} at most")
    return spark.createDataFrame([({n: draws(n, resamples, seed) for n in range(1, most + 1)},)], "drawn map<int, array<struct<times: array<int>, n: int>>>")


def _dot(times: Column, values: Column, most: int) -> Column:
    """The sum of products of two arrays of at most `most` entries, in order. Written out, as a nested lambda for each pair of
    entries takes many times as long."""
    total = F.lit(0.0)
    for k in range(most):
        total = total + F.coalesce(F.get(times, F.lit(k)) * F.get(values, F.lit(k)), F.lit(0.0))
    return total


def _quantile(ordered: Column, q: float) -> Column:
    """Linear between the two values beside the place; null for an empty array."""
    at = (F.size(ordered) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    a, b = F.get(ordered, low), F.coalesce(F.get(ordered, low + 1), F.get(ordered, low))
    return a + (b - a) * (at - low)



def intervals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`keys, lo, hi`: percentiles 2.5 and 97.5 of the mean over resampled strips of `keys, strip, value`; null for a group
    without a finite value."""
    clean = rows.withColumn("value", F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value")))
    held = stored(clean.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("strip", "value"))).alias("entries")), "strips")
    most = held.agg(F.max(F.size("entries"))).first()[0] or 1
    table = drawn(rows.sparkSession, most)
    values = F.transform("entries", lambda e: F.coalesce(e["value"], F.lit(0.0)))
    there = F.transform("entries", lambda e: e["value"].isNotNull().cast("double"))
    ready = spread(held, keys).select(*keys, F.size("entries").alias("n"), values.alias("values"), there.alias("there"), F.forall("entries", lambda e: e["value"].isNotNull()).alias("whole"))

    def mean(d: Column) -> Column:
        n = F.when(F.col("whole"), F.col("n").cast("double")).otherwise(_dot(d["times"], F.col("there"), most))
        return F.struct(F.try_divide(_dot(d["times"], F.col("values"), most), n).alias("mean"), d["n"].alias("n"))

    means = F.filter(F.transform(F.try_element_at("drawn", F.col("n")), mean), lambda m: m["mean"].isNotNull())
    ordered = ready.crossJoin(F.broadcast(table)).select(*keys, F.sort_array(means).alias("means"))  # one row
    each = ordered.select(*keys, F.flatten(F.transform("means", lambda m: F.array_repeat(m["mean"], m["n"]))).alias("means"))
    return each.select(*keys, _quantile(F.col("means"), 0.025).alias("lo"), _quantile(F.col("means"), 0.975).alias("hi"))


def stability(vectors: DataFrame, centres: DataFrame, assigned: DataFrame, digits: int = 9) -> DataFrame:
    """`sample_id, stability`: share of the resampled means of `vectors` (sample_id, strip, kpi, x) that lie nearest to the
    centroid of the batch in `assigned` (sample_id, assigned); a strip that lacks an indicator has 0 for it.

    The squared distance of a mean to a centroid is a part that all centroids share, less twice the mean's product with the
    centroid, and the centroid's square. Products with strips are sums, so what a resample needs is one number for each
    strip and batch. Of batches that are equally near up to rounding the smaller counts."""
    vectors = stored(vectors.select("sample_id", "strip", "kpi", "x"), "vectors")
    squares = centres.groupBy("batch").agg(F.sum(F.col("c") * F.col("c")).alias("norm"))
    along = vectors.join(F.broadcast(centres.select("batch", "kpi", "c")), "kpi").groupBy("sample_id", "strip", "batch").agg(F.sum(F.col("x") * F.col("c")).alias("h"))  # batches times indicators
    by_batch = along.groupBy("sample_id", "batch").agg(F.sort_array(F.collect_list(F.struct("strip", "h"))).alias("hs")).join(F.broadcast(squares), "batch")
    held = by_batch.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("batch", "norm", F.transform("hs", lambda s: s["h"]).alias("h")))).alias("entries"))
    most = vectors.groupBy("sample_id").agg(F.countDistinct("strip").alias("n")).agg(F.max("n")).first()[0] or 1
    table = drawn(vectors.sparkSession, most)
    both = spread(stored(held.join(assigned.select("sample_id", "assigned"), "sample_id"), "products"), ["sample_id"]).withColumn("n", F.size(F.get("entries", 0)["h"]))
    # A batch without a product for each strip is never nearest.
    whole = F.filter("entries", lambda e: e["norm"].isNotNull() & (F.size(e["h"]) == F.col("n")) & F.forall(e["h"], lambda h: h.isNotNull()))
    ready = both.select("sample_id", "assigned", "n", whole.alias("entries")).crossJoin(F.broadcast(table))  # one row
    found = F.try_element_at("drawn", F.col("n"))

    def nearest(times: Column) -> Column:
        far = F.transform("entries", lambda e: F.struct(F.round(e["norm"] - 2 * _dot(times, e["h"], most) / F.col("n"), digits).alias("d"), e["batch"].alias("batch")))
        return F.array_min(far)["batch"]

    hits = F.aggregate(F.transform(found, lambda d: F.when(nearest(d["times"]) == F.col("assigned"), d["n"]).otherwise(0)), F.lit(0), lambda a, n: a + n)
    all_ = F.aggregate(found, F.lit(0), lambda a, d: a + d["n"])
    return ready.select("sample_id", (hits / all_).alias("stability"))


def literal(most: int) -> str:
    """The multiplicities as a DuckDB table `n, b, pos, times`."""
    rows = ", ".join(f"({n}, {multiplicities(n)})" for n in range(1, most + 1))
    return f"(SELECT n, b, generate_subscripts(m, 1) - 1 AS pos, unnest(m) AS times FROM (SELECT n, generate_subscripts(ms, 1) AS b, unnest(ms) AS m FROM (VALUES {rows}) t(n, ms)))"
