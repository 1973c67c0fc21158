"""Segmentation of grey images into pores, carbon and silicon as one plan, with thresholds found in each image.

The smoothed image's levels give two thresholds by the largest variance between three classes. Pores are what lies below
the lower one by hysteresis, is dark in a second channel as well and has some size; silicon is what lies above the upper one
after an opening and is clearly brighter inside; the rest is carbon. Thresholds are a row an image and join back to its
pixels; components are connected over runs of all images at once, so no task holds an image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.tables import stored
from lamina.operators import grey as Y
from lamina.operators import grid as G

#: Levels above the lower threshold that a pore may reach, its least size, the share of carbon whose level
#: in the second channel bounds the dark, and levels by which silicon's inside lies above the upper threshold.
HYSTERESIS, PORE_PIXELS, DARK_SHARE, MARGIN = 6, 20, 0.1, 10
DIGITS = 6


def _kept(on: DataFrame, height: int, values: list[Column], keep: Column) -> DataFrame:
    """`image, r, c` of the components of `on` (image, r, c and more) for which `keep` holds of the aggregates `values`. Images
    lie below one another with a row between."""
    step = height + 1
    runs = G.components(on.select((F.col("image") * step + F.col("r")).alias("row"), F.col("c").alias("col"), F.lit(True).alias("on")))
    spread = runs.select("component", F.floor(F.col("row") / step).alias("image"), F.pmod("row", F.lit(step)).alias("r"), F.explode(F.sequence("first", "last")).alias("c"))
    good = spread.join(on.hint("merge"), Y.PLACE).groupBy("component").agg(*values).where(keep).select("component")
    return spread.join(good.hint("merge"), "component").select(*Y.PLACE)


def thresholds(smooth: DataFrame) -> DataFrame:
    """`image, t1, t2` of smoothed pixels `image, s`, by their levels; none for an image of fewer than three levels."""
    return Y.otsu(smooth.select("image", F.floor(F.col("s") + 0.5).alias("g")), ["image"])


def segmented(pixels: DataFrame, height: int, width: int, hysteresis: int = HYSTERESIS, pore_pixels: int = PORE_PIXELS, margin: int = MARGIN) -> DataFrame:
    """`image, r, c, s, t1, t2, phase` of pixels `image, r, c, g, e` with a second channel `e`; the phase is pore, doubtful (a
    pore by the first channel alone), si or carbon. In an image without thresholds all is carbon, in one without a pixel
    between them the second channel is not asked."""
    # Stored pixels are a hundredth of their size in memory, so a plan would broadcast them: joins are by merge.
    first = Y.smoothed(pixels, height, width).withColumn("s", F.round("s", DIGITS))
    second = Y.smoothed(pixels.select(*Y.PLACE, F.col("e").alias("g")), height, width).select(*Y.PLACE, F.round("s", DIGITS).alias("e"))
    both = stored(first.join(second.hint("merge"), Y.PLACE), "smoothed")
    cut = stored(both.join(thresholds(both).hint("merge"), "image", "left"), "thresholds")
    between = (F.col("s") >= F.col("t1")) & (F.col("s") < F.col("t2"))
    limit = cut.groupBy("image").agg(F.percentile(F.when(between, F.col("e")), F.lit(DARK_SHARE)).alias("limit"))

    weak = cut.where(F.col("s") <= F.col("t1") + hysteresis).select(*Y.PLACE, (F.col("s") <= F.col("t1")).alias("strong"))
    pore = stored(_kept(weak, height, [F.max("strong").alias("strong")], F.col("strong")).join(cut.hint("merge"), Y.PLACE).join(limit.hint("merge"), "image").select(*Y.PLACE, F.coalesce(F.col("e") < F.col("limit"), F.lit(True)).alias("dark")), "pores")
    dark = stored(_kept(pore.where("dark").select(*Y.PLACE), height, [F.count(F.lit(1)).alias("n")], F.col("n") >= pore_pixels), "dark-pores")

    bright = stored(Y.dilated(Y.eroded(cut.where(F.col("s") >= F.col("t2")).select(*Y.PLACE)), height, width), "bright")
    inner = Y.eroded(bright).join(cut.hint("merge"), Y.PLACE).select(*Y.PLACE, (F.col("s") - F.col("t2")).alias("above"))
    silicon = stored(_kept(bright.join(inner.hint("merge"), Y.PLACE, "left"), height, [F.percentile("above", F.lit(0.5)).alias("above")], F.col("above") >= margin), "silicon")

    marks = dark.withColumn("phase", F.lit("pore")).unionByName(pore.where("NOT dark").select(*Y.PLACE, F.lit("doubtful").alias("phase")))
    rest = cut.join(marks.hint("merge"), Y.PLACE, "left").join(silicon.withColumn("bright", F.lit(True)).hint("merge"), Y.PLACE, "left")
    # A doubtful pixel is no pore, so silicon may have it.
    phase = F.when(F.col("phase") == "pore", "pore").when(F.col("bright"), "si").otherwise(F.coalesce("phase", F.lit("carbon")))
    return stored(rest.select(*Y.PLACE, "s", "t1", "t2", phase.alias("phase")), "segmented")


def fractions(labels: DataFrame, keys: list[str]) -> DataFrame:
    """`keys, pore, doubtful, si, si_solid` of label maps: shares of the area, and silicon's of the solid (null without any)."""

    def n(name: str) -> Column:
        return F.count(F.when(F.col("phase") == name, 1))

    solid = F.count(F.when(F.col("phase") != "pore", 1))
    return labels.groupBy(*keys).agg(*[(n(k) / F.count(F.lit(1))).alias(k) for k in ("pore", "doubtful", "si")], F.try_divide(n("si").cast("double"), solid).alias("si_solid"))


def with_errors(labels: DataFrame, width: int, strips: int = 5) -> DataFrame:
    """`image, kpi, value, se`: each share over the image, with the standard error that the strips' spread implies."""
    names = ["pore", "doubtful", "si", "si_solid"]
    whole = fractions(labels, ["image"]).unpivot(["image"], names, "kpi", "value")
    each = fractions(labels.withColumn("strip", Y.strip_of(F.col("c"), width, strips)), ["image", "strip"]).unpivot(["image", "strip"], names, "kpi", "x")
    spread = each.groupBy("image", "kpi").agg(F.when(F.count("x") >= 2, F.stddev_samp("x") / F.sqrt(F.count("x"))).alias("se"))
    return whole.join(spread.hint("merge"), ["image", "kpi"])
