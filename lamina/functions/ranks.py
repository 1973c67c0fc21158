"""Counts of reference values beside each row, without a window over everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.tables import stored

RANGES = 64


def count_beside(rows: DataFrame, reference: DataFrame, value: str, above: bool) -> DataFrame:
    """`rows` with `n_beside`, the number of reference values that are at least as large (or, if not `above`, at most
    as large), and `n_reference`. Rows without a value are left out.

    Cut points from the reference deal both sides into ranges; a range is counted by itself, and the totals of the
    ranges beyond it, one row each, are added."""
    clean = stored(reference.where(F.col(value).isNotNull()).select(F.col(value).alias("__v")), "reference")
    cuts = sorted(set(clean.approxQuantile("__v", [i / RANGES for i in range(1, RANGES)], 0.005)))
    place = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col("__v"))) if cuts else F.lit(0)
    both = rows.where(F.col(value).isNotNull()).withColumns({"__v": F.col(value), "__ref": F.lit(0)})
    dealt = both.unionByName(clean.withColumn("__ref", F.lit(1)), allowMissingColumns=True).withColumn("__range", place)
    totals = clean.withColumn("__range", place).groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    beyond = {r["__range"]: r["__n"] for r in totals.collect()}  # RANGES rows at most
    whole = sum(beyond.values())
    outside = F.lit(0)
    for k in range(len(cuts) + 1):
        outside = F.when(F.col("__range") == k, sum(n for j, n in beyond.items() if (j > k if above else j < k))).otherwise(outside)
    order = F.desc("__v") if above else F.asc("__v")
    own = F.sum("__ref").over(Window.partitionBy("__range").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    counted = dealt.withColumns({"n_beside": own + outside, "n_reference": F.lit(whole)})
    return counted.where("__ref = 0").drop("__v", "__ref", "__range")
