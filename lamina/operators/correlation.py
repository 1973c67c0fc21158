"""Two-point statistics of masks, from the ends of their runs.

How many pairs of set pixels lie a shift apart is a sum over rows. Along a row, the second difference of these counts is
the correlation of the run ends, a +1 where a run begins and a -1 behind its last pixel, so only ends have to meet ends
of one other row and pixels never meet pixels. Rows close to a circle, as the shifts wrap around; two sums give back what
second differences leave open: counts repeat after a turn, and over a turn they add up to the product of the rows' areas.
All counts are whole numbers, so nothing is rounded before the last step.
"""

from __future__ import annotations

from math import e

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators import grid as G

#: Means of the radial profile are compared with zero after rounding to so many digits.
DIGITS = 9


def _ends(on: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """`keys, r, at, s` of the run ends of masks `keys, r, c`, on rows closed to circles; ends that meet cancel."""
    line = F.struct(*keys, "r")
    found = G.runs(on.select(line.alias("line"), F.col("c").alias("at"), F.lit(True).alias("on")), "line", "at")
    both = F.array(F.struct(F.col("first").alias("at"), F.lit(1).alias("s")), F.struct(F.pmod(F.col("last") + 1, F.lit(width)).alias("at"), F.lit(-1).alias("s")))
    each = found.select("line.*", F.explode(both).alias("e"))
    return each.groupBy(*keys, "r", F.col("e.at").alias("at")).agg(F.sum("e.s").alias("s")).where("s <> 0")


def pair_counts(on: DataFrame, keys: list[str], height: int, width: int, reach: int = 0) -> DataFrame:
    """`keys, dr, d, n`: pairs of set pixels of which the second is `dr` rows (0 to `reach`) down and `d` columns (0 to
    width - 1) to the right, around the frame. Groups of `keys` without a set pixel have no row."""
    shifts = F.explode(F.array(*[F.lit(k).cast("long") for k in range(reach + 1)])).alias("dr")

    def down(rows: DataFrame) -> DataFrame:
        """Rows with the row `q` they meet."""
        return rows.select("*", shifts).withColumn("q", F.pmod(F.col("r") + F.col("dr"), F.lit(height)))

    # Stored masks are a hundredth of their size in memory, so a plan would broadcast what follows from them: joins are by merge.
    ends = _ends(on, keys, height, width)
    other = ends.select(*keys, F.col("r").alias("q"), F.col("at").alias("to"), F.col("s").alias("t"))
    bends = down(ends).join(other.hint("merge"), [*keys, "q"]).groupBy(*keys, "dr", F.pmod(F.col("to") - F.col("at"), F.lit(width)).alias("d")).agg((-F.sum(F.col("s") * F.col("t"))).alias("bend"))
    areas = on.groupBy(*keys, "r").agg(F.count(F.lit(1)).alias("a"))
    products = down(areas).join(areas.select(*keys, F.col("r").alias("q"), F.col("a").alias("b")).hint("merge"), [*keys, "q"], "left").groupBy(*keys, "dr").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("total"))
    dense = products.withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))))
    order = Window.partitionBy(*keys, "dr").orderBy("d")
    whole = Window.partitionBy(*keys, "dr")
    curve = dense.join(bends.hint("merge"), [*keys, "dr", "d"], "left").withColumn("slope", F.sum(F.when(F.col("d") > 0, F.coalesce("bend", F.lit(0))).otherwise(0)).over(order))
    curve = curve.withColumn("rise", F.coalesce(F.sum("slope").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    curve = curve.withColumn("first", (-F.sum("slope").over(whole) / width).cast("long")).withColumn("part", F.col("rise") + F.col("first") * F.col("d"))
    start = ((F.col("total") - F.sum("part").over(whole)) / width).cast("long")
    return curve.select(*keys, "dr", "d", (F.col("part") + start).alias("n"))


def _correlation(n: Column, share: Column, area: int) -> Column:
    return (n / area - share**2) / (share * (1 - share))


def _length(profile: DataFrame, keys: list[str], size: int) -> DataFrame:
    """`keys, length`: where the correlation `d, c` first falls below 1/e, linear between shifts; `size` if it doesn't."""
    near = profile.where(F.col("d") < size).withColumn("before", F.lag("c").over(Window.partitionBy(*keys).orderBy("d")))
    limit = 1 / e
    first = F.min(F.when(F.col("c") < limit, F.struct("d", "c", "before"))).alias("f")
    between = F.when(F.col("f.before") != F.col("f.c"), F.col("f.d") - 1 + (F.col("f.before") - limit) / (F.col("f.before") - F.col("f.c"))).otherwise(F.col("f.d").cast("double"))
    return near.groupBy(*keys).agg(first).select(*keys, F.when(F.col("f").isNull(), F.lit(float(size))).otherwise(between).alias("length"))


def two_point(on: DataFrame, groups: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """`keys, length_h, length_v, integral_range, se` for every row of `groups`: how far the correlation of a mask reaches
    along rows and columns, the sum of the correlation over the disc out to where its radial mean first reaches zero (1 at
    least), and the standard error of the mask's share that follows. A mask that is empty or full has 0, 0, 1 and 0."""
    area = height * width
    share = on.groupBy(*keys).agg((F.count(F.lit(1)) / area).alias("share")).where("share < 1")
    reach = min(height, width) // 4

    def correlated(counts: DataFrame) -> DataFrame:
        return counts.join(share, keys).withColumn("c", _correlation(F.col("n"), F.col("share"), area))

    rows = correlated(pair_counts(on, keys, height, width, reach))
    along = _length(rows.where("dr = 0").select(*keys, "d", "c"), keys, width // 2).withColumnRenamed("length", "length_h")
    turned = on.select(*keys, F.col("c").alias("r"), F.col("r").alias("c"))
    down = _length(correlated(pair_counts(turned, keys, width, height)).select(*keys, "d", "c"), keys, height // 2).withColumnRenamed("length", "length_v")
    # The half disc below stands for the one above, turned by half.
    x = F.when(F.col("d") > width // 2, F.col("d") - width).otherwise(F.col("d"))
    disc = rows.withColumns({"x": x, "ring": F.floor(F.sqrt((x * x + F.col("dr") * F.col("dr")).cast("double")))}).where(F.abs("x") <= reach)
    rings = disc.groupBy(*keys, "ring").agg(F.sum(F.col("c") * F.when(F.col("dr") > 0, 2).otherwise(1)).alias("sum"), F.sum(F.when(F.col("dr") > 0, 2).otherwise(1)).alias("cells"))
    end = F.coalesce(F.min(F.when((F.col("ring") <= reach) & (F.round(F.col("sum") / F.col("cells"), DIGITS) <= 0), F.col("ring"))).over(Window.partitionBy(*keys)), F.lit(reach))
    ranges = rings.withColumn("end", end).groupBy(*keys).agg(F.greatest(F.coalesce(F.sum(F.when(F.col("ring") < F.col("end"), F.col("sum"))), F.lit(0.0)), F.lit(1.0)).alias("integral_range"))
    full = groups.select(*keys).join(share, keys, "left").join(along, keys, "left").join(down, keys, "left").join(ranges, keys, "left")
    se = F.sqrt(F.col("share") * (1 - F.col("share")) * F.col("integral_range") / area)
    return full.select(*keys, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("length_h", "length_v")], F.coalesce("integral_range", F.lit(1.0)).alias("integral_range"), F.coalesce(se, F.lit(0.0)).alias("se"))
