"""Size and shape of particles from the runs of their rows: moments, boundary length, convex hull.

Sums over a run have a closed form, the boundary along a direction is what neighbours in that direction leave open, and the hull
needs only the two ends of each row. So a particle is a few sums and one array as long as it is high, never its pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators import grid as G


def _moments(runs: DataFrame) -> DataFrame:
    """`component, n, mr, mc, vr, vc, cov`: area, centre and second moments of pixels as unit squares."""
    a, b, r = (F.col(k).cast("double") for k in ("first", "last", "row"))
    n = b - a + 1
    line = n * (a + b) / 2
    square = (b * (b + 1) * (2 * b + 1) - (a - 1) * a * (2 * a - 1)) / 6
    # Rows count from the particle's own top, so that large row numbers cost no digits.
    at = r - F.min("row").over(Window.partitionBy("component"))
    each = runs.select("component", "row", n.alias("n"), at.alias("r"), line.alias("sc"), square.alias("scc"))
    sums = each.groupBy("component").agg(
        F.min("row").alias("top"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("r")).alias("sr"),
        F.sum("sc").alias("sc"),
        F.sum(F.col("n") * F.col("r") ** 2).alias("srr"),
        F.sum("scc").alias("scc"),
        F.sum(F.col("sc") * F.col("r")).alias("src"),
    )
    area = F.col("n")
    sums = sums.withColumns({"mr": F.col("sr") / area, "mc": F.col("sc") / area})
    spread = [(F.col("srr") / area - F.col("mr") ** 2 + 1 / 12).alias("vr"), (F.col("scc") / area - F.col("mc") ** 2 + 1 / 12).alias("vc"), (F.col("src") / area - F.col("mr") * F.col("mc")).alias("cov")]
    return sums.select("component", area.cast("long").alias("n"), (F.col("top") + F.col("mr")).alias("mr"), "mc", *spread)


def _boundary(runs: DataFrame) -> DataFrame:
    """`component, perimeter`: boundary length from crossings of lines in four directions; the frame counts as boundary. A row
    of pixels crosses twice for each pixel without a neighbour of its own particle; runs meet those of the next row in buckets."""
    shifted = runs.withColumn("s", F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)])))
    upper = shifted.select("component", (F.col("row") + 1).alias("row"), "s", (F.col("first") + F.col("s")).alias("a"), (F.col("last") + F.col("s")).alias("b"))
    lower = runs.select("component", "row", F.col("first").alias("a2"), F.col("last").alias("b2"))

    def bucketed(rows: DataFrame, first: str, last: str) -> DataFrame:
        return rows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(first) / G.BUCKET), F.floor(F.col(last) / G.BUCKET))))

    both = bucketed(upper, "a", "b").join(bucketed(lower, "a2", "b2").hint("merge"), ["component", "row", "bucket"])
    start, end = F.greatest("a", "a2"), F.least("b", "b2")
    met = both.where((start <= end) & (F.col("bucket") == F.floor(start / G.BUCKET)))
    pairs = met.groupBy("component").agg(*[F.coalesce(F.sum(F.when(c, end - start + 1)), F.lit(0)).alias(k) for k, c in (("down", F.col("s") == 0), ("slanted", F.col("s") != 0))])
    own = runs.groupBy("component").agg(F.sum(F.col("last") - F.col("first") + 1).alias("n"), F.count(F.lit(1)).alias("lines")).join(pairs.hint("merge"), "component", "left")
    down, slanted = F.coalesce("down", F.lit(0)), F.coalesce("slanted", F.lit(0))
    straight = 2 * F.col("lines") + 2 * (F.col("n") - down)
    length = F.pi() / 8 * (straight + (4 * F.col("n") - 2 * slanted) / F.sqrt(F.lit(2.0)))
    return own.select("component", length.alias("perimeter"))


def _chain(points: Column, side: int) -> Column:
    """Area between an axis and the convex chain over points `y, x` in ascending y: for `side` 1 no point lies at larger x than
    the chain, for -1 none at smaller. A new point is joined to the corner from which the chain turns farthest outwards, the
    first of equals, and the corners after it go."""

    def slope(p: Column, q: Column) -> Column:
        return side * (q["x"] - p["x"]) / (q["y"] - p["y"])

    def joined(chain: Column, p: Column) -> Column:
        slopes = F.transform(chain, lambda c: slope(c, p))
        return F.when(F.size(chain) == 0, F.array(p)).otherwise(F.concat(F.slice(chain, 1, F.array_position(slopes, F.array_min(slopes)).cast("int")), F.array(p)))

    empty = F.slice(points, 1, 0)
    corners = F.aggregate(points, empty, joined)
    under = F.zip_with(F.slice(corners, 1, F.size(corners) - 1), F.slice(corners, 2, F.size(corners)), lambda p, q: (q["y"] - p["y"]) * (p["x"] + q["x"]) / 2)
    return F.aggregate(under, F.lit(0.0), lambda s, v: s + v)


def hulls(runs: DataFrame) -> DataFrame:
    """`component, hull`: area of the convex hull of the corners of the pixels. A component has one array of its rows' ends."""
    sides = runs.groupBy("component", "row").agg(F.min("first").alias("lo"), (F.max("last") + 1).alias("hi"))
    corners = sides.select("component", "lo", "hi", F.explode(F.array("row", F.col("row") + 1)).alias("y"))
    lines = corners.groupBy("component", "y").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    y, lo, hi = (F.col(k).cast("double").alias(k) for k in ("y", "lo", "hi"))
    whole = lines.groupBy("component").agg(F.sort_array(F.collect_list(F.struct(y, lo, hi))).alias("p"))

    def points(x: str) -> Column:
        return F.transform("p", lambda q: F.struct((q["y"] - F.col("p")[0]["y"]).alias("y"), q[x].alias("x")))

    return whole.select("component", points("lo").alias("left"), points("hi").alias("right")).select("component", (_chain(F.col("right"), 1) - _chain(F.col("left"), -1)).alias("hull"))


def shapes(runs: DataFrame, least: int = 1) -> DataFrame:
    """`component, n, row, col, ecd, aspect, direction, solidity, circularity` of runs `row, first, last, component` of components
    of `least` pixels or more: pixels, centre, equivalent diameter, ratio of the axes of the ellipse with the same second moments,
    direction of its long axis in degrees, over -90 to 90 (null if both are equal), share of the hull that is set, and 4 pi area over squared
    boundary length, 1.5 at most."""
    size = F.sum(F.col("last") - F.col("first") + 1).over(Window.partitionBy("component"))
    own = runs.select("component", "row", "first", "last").withColumn("__n", size).where(F.col("__n") >= least).drop("__n")
    both = _moments(own).join(_boundary(own).hint("merge"), "component").join(hulls(own).hint("merge"), "component")
    n = F.col("n").cast("double")
    mid, off = (F.col("vr") + F.col("vc")) / 2, F.sqrt(((F.col("vr") - F.col("vc")) / 2) ** 2 + F.col("cov") ** 2)
    tilt = F.when(F.round(off, 9) > 0, F.degrees(0.5 * F.atan2(F.lit(0.0) - 2 * F.round("cov", 9), F.col("vc") - F.col("vr"))))
    return both.select(
        "component",
        "n",
        F.col("mr").alias("row"),
        F.col("mc").alias("col"),
        (2 * F.sqrt(n / F.pi())).alias("ecd"),
        F.sqrt((mid + off) / (mid - off)).alias("aspect"),
        tilt.alias("direction"),
        (n / F.col("hull")).alias("solidity"),
        F.least(4 * F.pi() * n / F.col("perimeter") ** 2, F.lit(1.5)).alias("circularity"),
    )


def interior_spread(levels: DataFrame, labelled: DataFrame, inner: DataFrame, place: list[str]) -> DataFrame:
    """`component, texture`: the deviation of levels `place, s` over the pixels `inner` of labelled pixels `place, component`."""
    # Stored pixels are a hundredth of their size in memory, so a plan would broadcast them: joins are by merge.
    return inner.hint("merge").join(labelled.hint("merge"), place).join(levels.hint("merge"), place).groupBy("component").agg(F.stddev_pop("s").alias("texture"))
