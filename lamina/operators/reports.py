"""Tables behind reports: ordered drivers, counts of changes, descriptions, relative indices, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Metres of an inch and a centimetre, the units of resolution tags (2 and 3), constants of the cell model.
METRES_OF_UNIT = {2: 0.0254, 3: 0.01}
INACTIVE_OF_SOLIDS, LEAST_GRAPHITE = 0.08, 0.01


def drivers(scored: DataFrame, order: list[str], top: int) -> DataFrame:
    """`sample_id, place, kpi, z, direction`: a sample's indicators by falling absolute z, ties in the order given."""
    at = F.array_position(F.array(*[F.lit(k) for k in order]), F.col("kpi"))
    falling = Window.partitionBy("sample_id").orderBy(F.desc(F.round(F.abs("z"), 9)), at)
    ranked = scored.where("z IS NOT NULL").withColumn("place", F.row_number().over(falling).cast("long"))
    return ranked.where(F.col("place") <= top).select("sample_id", "place", "kpi", "z", F.when(F.col("z") > 0, "high").when(F.col("z") < 0, "low").otherwise("equal").alias("direction"))


def largest(rows: DataFrame, keys: list[str], value: str, name: str, top: int) -> DataFrame:
    """The `top` rows of each group with the largest value, ties by name."""
    falling = Window.partitionBy(*keys).orderBy(F.desc(F.round(value, 9)), name)
    return rows.withColumn("place", F.row_number().over(falling).cast("long")).where(F.col("place") <= top)


def changes(diff: DataFrame) -> DataFrame:
    """`kpi, n_changed, largest`: how many samples changed in an indicator, and by how many scales at most."""
    return diff.where("changed").groupBy("kpi").agg(F.count(F.lit(1)).alias("n_changed"), F.max("delta_scale").alias("largest"))


def described(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles."""
    quartiles = [F.percentile(value, F.lit(q)).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)]
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("least"), *quartiles, F.max(value).alias("most"))


def present(wide: DataFrame, keys: list[str], wanted: list[str]) -> DataFrame:
    """`keys, kpi, value` of those wanted columns that the table has."""
    return wide.unpivot(keys, [c for c in wanted if c in wide.columns], "kpi", "value")


def pixel_nm(top: Column, bottom: Column, unit: Column) -> Column:
    """Pixel size in nanometres from a resolution tag; null if it is 1 or less, without a unit, or not a number."""
    resolution = F.when(bottom != 0, top / bottom)
    metres = F.when(unit == 2, METRES_OF_UNIT[2]).otherwise(METRES_OF_UNIT[3])
    return F.when((resolution > 1) & (unit != 1), 1e9 / (resolution / metres))


def manifest(grouped: DataFrame) -> DataFrame:
    """A row for each sample: batch, the channels' paths, and what is known of them."""
    paths = [F.col("paths")[c].alias(f"path_{c.lower()}") for c in ("BSE", "ETD", "Inlens")]
    return grouped.select("sample_id", "batch", *paths, F.coalesce("etd_is_se", F.lit(False)).alias("etd_is_se"), F.col("has_prefix").alias("has_batch_prefix"), "complete")


def weighted_mean(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("mean"))


def relative(rows: DataFrame, keys: list[str], names: list[str], is_base: Column) -> DataFrame:
    """Each of `names` over its median in the base rows; null where either is missing or the median is 0."""
    base = rows.where(is_base).agg(*[F.percentile(n, F.lit(0.5)).alias(f"base_{n}") for n in names])
    both = rows.crossJoin(F.broadcast(base))  # one row
    return both.select(*keys, *[F.try_divide(F.col(n), F.col(f"base_{n}")).alias(n) for n in names])


def cell_fractions(porosity: Column, f_si: Column) -> dict[str, Column]:
    """Volume fractions of graphite and silicon in an electrode of that porosity."""
    solids = 1 - porosity
    silicon = f_si * solids
    return {"graphite": F.greatest(solids - silicon - INACTIVE_OF_SOLIDS * solids, F.lit(LEAST_GRAPHITE)), "silicon": silicon}


def capacity_ratio(negative: list[tuple[Column, float]], negative_um: float, positive: tuple[float, float], positive_um: float) -> Column:
    """Areal capacity of the negative electrode over that of the positive, from volume fractions and concentrations."""
    total = sum((share * most for share, most in negative), F.lit(0.0))
    return total * negative_um / (positive[0] * positive[1] * positive_um)
