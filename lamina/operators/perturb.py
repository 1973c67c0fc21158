"""How far brightness, contrast and gamma of the given images move their indicators and verdicts.

Each of these changes is a map of grey levels that depends on an image's mean alone. So all indicators that are shares of levels
follow, under every change, from one histogram per image and strip: pixels are read once, whatever the number of changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.tables import stored
from lamina.operators import baseline as B

#: Brightness, contrast and gamma of each change, and the shift in baseline scales that counts as robust.
CHANGES = {"brightness+15%": (1.15, 1.0, 1.0), "contrast x0.85": (1.0, 0.85, 1.0), "gamma 1.2": (1.0, 1.0, 1.2)}
ROBUST = 0.25
KPIS = ["si_frac_solid", "si_frac_total", "pore_frac_deep", "ambiguous_frac"]
DIGITS = 9


def changed(level: Column, mean: Column, brightness: float, contrast: float, gamma: float) -> Column:
    """The grey level that a change makes of a level: contrast around the image's mean, then brightness, then gamma."""
    moved = F.least(F.greatest(((level - mean) * contrast + mean) * brightness, F.lit(0.0)), F.lit(255.0))
    return F.rint(F.round(255 * F.pow(moved / 255, F.lit(gamma)), DIGITS)).cast("long")


def histograms(pixels: DataFrame, strip: Column) -> DataFrame:
    """`image, strip, g, n, mean`: pixels of each level in a strip, with the mean of the image."""
    counts = stored(pixels.groupBy("image", strip.alias("strip"), "g").agg(F.count(F.lit(1)).alias("n")), "histograms")
    mean = counts.groupBy("image").agg((F.sum(F.col("n") * F.col("g")) / F.sum("n")).alias("mean"))
    return counts.join(mean, "image")


def shares(counts: DataFrame, keys: list[str], level: Column, low: int, high: int, beside: int = 4) -> DataFrame:
    """The four shares of each group from counts `n` of levels."""
    g = F.col("__g")
    near = (F.abs(g - low) <= beside) | (F.abs(g - high) <= beside)

    def n(what: Column) -> Column:
        return F.coalesce(F.sum(F.when(what, F.col("n"))), F.lit(0))

    area = F.sum("n")
    own = [n(g >= high) / F.greatest(n(g >= low), F.lit(1)), n(g >= high) / area, n(g < low) / area, n(near) / area]
    return counts.withColumn("__g", level).groupBy(*keys).agg(*[v.alias(k) for k, v in zip(KPIS, own, strict=True)])


def facts(counts: DataFrame, low: int, high: int, level: Column | None = None) -> DataFrame:
    """`sample_id, batch, kpi, value, se` of the images, all of one batch, with the errors that strips imply."""
    at = F.col("g") if level is None else level
    whole = shares(counts, ["image"], at, low, high).unpivot(["image"], KPIS, "kpi", "value")
    strips = shares(counts, ["image", "strip"], at, low, high).unpivot(["image", "strip"], KPIS, "kpi", "x")
    se = strips.groupBy("image", "kpi").agg(F.when(F.count(F.lit(1)) >= 2, F.stddev_samp("x") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return whole.join(se, ["image", "kpi"]).select(F.col("image").alias("sample_id"), F.lit(0).cast("long").alias("batch"), "kpi", "value", "se")


def perturbed(counts: DataFrame, low: int, high: int, changes: dict[str, tuple[float, float, float]] = CHANGES) -> DataFrame:
    """`image, change, kpi, value, moved, z, z_moved, shift` of every image, change and indicator: values and z-scores without
    and with the change, against the baseline of all unchanged images, and the shift in scales (the least scale is 1e-9)."""
    own = stored(facts(counts, low, high), "facts")
    stats = stored(B.baseline(own, 0), "baseline")
    base = B.zscores(own, stats).select("sample_id", "kpi", "value", "z")
    out = None
    for name, change in changes.items():
        moved = facts(counts, low, high, changed(F.col("g"), F.col("mean"), *change))
        each = B.zscores(moved, stats).select("sample_id", "kpi", F.lit(name).alias("change"), F.col("value").alias("moved"), F.col("z").alias("z_moved"))
        out = each if out is None else out.unionByName(each)
    scale = F.broadcast(stats.select("kpi", "scale"))  # a row an indicator
    both = out.join(base, ["sample_id", "kpi"]).join(scale, "kpi")
    shift = F.try_divide(F.abs(F.col("moved") - F.col("value")), F.col("scale"))
    return both.select(F.col("sample_id").alias("image"), "change", "kpi", "value", "moved", "z", "z_moved", shift.alias("shift"))


def robustness(rows: DataFrame) -> DataFrame:
    """`image, change, worst_kpi, worst_shift, n_over, ok, decision, decision_moved, same`: the indicator that moves farthest
    (the first by name of equals), how many move by ROBUST scales or more, and the verdicts without and with the change."""
    shift = F.round("shift", DIGITS)
    worst = F.min(F.when(shift.isNotNull(), F.struct((-shift).alias("s"), F.col("kpi").alias("kpi")))).alias("w")
    own = rows.groupBy("image", "change").agg(worst, F.count(F.when(shift >= ROBUST, 1)).alias("n_over"))

    def verdict(z: str, name: str) -> DataFrame:
        each = rows.select(F.col("image").alias("sample_id"), F.lit(0).cast("long").alias("batch"), "change", F.col(z).alias("z"))
        return B.verdicts(each, by=["change"]).select(F.col("sample_id").alias("image"), "change", F.col("decision").alias(name))

    both = own.join(verdict("z", "decision"), ["image", "change"]).join(verdict("z_moved", "decision_moved"), ["image", "change"])
    return both.select("image", "change", F.col("w.kpi").alias("worst_kpi"), (-F.col("w.s")).alias("worst_shift"), "n_over", (F.col("n_over") == 0).alias("ok"), "decision", "decision_moved", (F.col("decision") == F.col("decision_moved")).alias("same"))
