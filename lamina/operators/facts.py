"""Long-format facts: one row for each sample and indicator, with its value and standard error.

On the driver's tables a sample is a supplier, its batch the supplier's region, a strip the fifth of its line
items that the order key assigns, and the indicators are means over line items. Strips are summed once; image
values and standard errors both follow from the sums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.tables import stored

STRIPS = 5
BASELINE = 3


@dataclass(frozen=True)
class Indicator:
    name: str
    unit: str
    rank: str  # R robust, M middling, W weak
    of: str  # SQL expression over a line item


#: Weights of the robustness ranks, and floors of the scale by unit.
WEIGHTS = {"R": 1.0, "M": 0.7, "W": 0.4}
ABS_FLOOR = {"fraction": 0.005}
INDICATORS = [
    Indicator("qty_mean", "pieces", "R", "l_quantity"),
    Indicator("price_mean", "money", "R", "l_extendedprice"),
    Indicator("unit_price_mean", "money", "R", "l_extendedprice / l_quantity"),
    Indicator("discount_mean", "fraction", "M", "l_discount"),
    Indicator("returned_frac", "fraction", "M", "CASE WHEN l_returnflag = 'R' THEN 1.0D ELSE 0.0D END"),
    Indicator("open_frac", "fraction", "W", "CASE WHEN l_linestatus = 'O' THEN 1.0D ELSE 0.0D END"),
]
#: Covariates of the acquisition, never features of the classifier.
GATES = [
    Indicator("tax_mean", "fraction", "R", "l_tax"),
    Indicator("line_number_mean", "", "R", "CAST(l_linenumber AS DOUBLE)"),
]


def weight(name: Column) -> Column:
    out = F.lit(WEIGHTS["M"])
    for i in INDICATORS:
        out = F.when(name == i.name, WEIGHTS[i.rank]).otherwise(out)
    return out


def abs_floor(name: Column) -> Column:
    out = F.lit(0.0)
    for i in INDICATORS:
        out = F.when(name == i.name, ABS_FLOOR.get(i.unit, 0.0)).otherwise(out)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`sample_id, batch`."""
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    placed = supplier.join(F.broadcast(nation), supplier["s_nationkey"] == nation["n_nationkey"])  # 25 nations
    return placed.select(F.col("s_suppkey").alias("sample_id"), F.col("n_regionkey").cast("long").alias("batch"))


def strip_sums(spark: SparkSession, sf_dir: str, indicators: list[Indicator] = INDICATORS) -> DataFrame:
    """`sample_id, batch, strip, n` and the sum of each indicator: the only pass over line items."""
    lines = table(spark, sf_dir, "lineitem").withColumn("strip", F.pmod("l_orderkey", F.lit(STRIPS)))
    sums = lines.groupBy(F.col("l_suppkey").alias("sample_id"), "strip").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.expr(i.of)).alias(i.name) for i in indicators])
    return sums.join(samples(spark, sf_dir), "sample_id")


def _long(wide: DataFrame, keys: list[str], indicators: list[Indicator]) -> DataFrame:
    return wide.unpivot(keys, [i.name for i in indicators], "kpi", "value")


def strip_facts(spark: SparkSession, sf_dir: str, indicators: list[Indicator] = INDICATORS) -> DataFrame:
    """`sample_id, batch, strip, kpi, value`."""
    sums = strip_sums(spark, sf_dir, indicators)
    means = sums.select("sample_id", "batch", "strip", *[(F.col(i.name) / F.col("n")).alias(i.name) for i in indicators])
    return _long(means, ["sample_id", "batch", "strip"], indicators)


def facts(spark: SparkSession, sf_dir: str, indicators: list[Indicator] = INDICATORS) -> DataFrame:
    """`sample_id, batch, kpi, value, se`: the mean over all line items, and the standard error that the spread
    of the strips implies (null with fewer than two strips). Facts are few and used several times over, so they are
    stored: whatever follows, line items are read once."""
    sums = strip_sums(spark, sf_dir, indicators)
    keys = ["sample_id", "batch"]
    means = {i.name: F.sum(i.name) / F.sum("n") for i in indicators}
    errors = {i.name: F.when(F.count(F.lit(1)) >= 2, F.stddev_samp(F.col(i.name) / F.col("n")) / F.sqrt(F.count(F.lit(1)))) for i in indicators}
    wide = sums.groupBy(*keys).agg(*[F.struct(means[i.name].alias("value"), errors[i.name].alias("se")).alias(i.name) for i in indicators])
    return stored(_long(wide, keys, indicators).select(*keys, "kpi", F.col("value.value").alias("value"), F.col("value.se").alias("se")), "facts")
