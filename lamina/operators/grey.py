"""Operators on grey images given as pixels `image, r, c, g`, many images in one table.

All of them are aggregations over pixels, or sums of neighbours that a pixel hands on to the places it counts for, so
nothing gathers an image in one task.
"""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the smoothing kernel, levels of a grey image, and the drift of a threshold that is flagged.
SIGMA = 1.5
LEVELS = 256
SHADING_LEVELS = 6.0
PLACE = ["image", "r", "c"]


def phases(low: int, high: int) -> dict[str, Column]:
    """Pore, silicon and carbon by two thresholds."""
    g = F.col("g")
    return {"pore": g < low, "si": g >= high, "carbon": (g >= low) & (g < high)}


def fractions(pixels: DataFrame, keys: list[str], low: int, high: int, beside: int = 4) -> DataFrame:
    """The four phase fractions of each group."""
    p = phases(low, high)
    n = {k: F.sum(v.cast("long")) for k, v in p.items()}
    near = (F.abs(F.col("g") - low) <= beside) | (F.abs(F.col("g") - high) <= beside)
    area = F.count(F.lit(1))
    return pixels.groupBy(*keys).agg(
        area.alias("area"),
        (n["si"] / F.greatest(n["si"] + n["carbon"], F.lit(1))).alias("si_frac_solid"),
        (n["si"] / area).alias("si_frac_total"),
        (n["pore"] / area).alias("pore_frac_deep"),
        F.avg(near.cast("double")).alias("ambiguous_frac"),
    )


def strip_of(at: Column, size: int, strips: int) -> Column:
    """The number of the strip of equal width that holds a position; edges are cut to whole numbers."""
    return sum(((at >= k * size // strips).cast("int") for k in range(1, strips)), F.lit(0)).cast("long")


def depth_slopes(pixels: DataFrame, height: int, pixel_um: float, low: int, high: int, bands: int = 5) -> DataFrame:
    """`image, pore_slope, si_slope`: percentage points in 10 micrometres of depth, over the centres of the bands."""
    edges = [k * height // bands for k in range(bands + 1)]
    band = sum(((F.col("r") >= e).cast("int") for e in edges[1:-1]), F.lit(0))
    centre = F.element_at(F.array(*[F.lit((a + b) / 2 * pixel_um) for a, b in zip(edges, edges[1:], strict=False)]), F.col("band") + 1)
    p = phases(low, high)
    share = {k: (F.avg(p[k].cast("double")) * 100).alias(k) for k in ("pore", "si")}
    each = pixels.withColumn("band", band).groupBy("image", "band").agg(*share.values())
    return each.groupBy("image").agg(*[(F.regr_slope(k, centre) * 10).alias(f"{k}_slope") for k in share])


def _handed(pixels: DataFrame, along: str, value: str, targets: Column, *more: Column) -> DataFrame:
    """Sums, by place, of what the pixels hand on along one direction; `targets` has structs of place and weight. `more` are
    further aggregates over the pixels that meet at a place, with their target as `t`."""
    rest = [k for k in PLACE if k != along]
    each = pixels.select("*", F.explode(targets).alias("t"), F.col(along).alias("__from")).drop(along)
    return each.groupBy(*rest, F.col("t.at").alias(along)).agg(F.sum(F.col(value) * F.col("t.w")).alias(value), *more)


def _weights(sigma: float) -> list[float]:
    radius = int(4 * sigma + 0.5)
    raw = [exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [x / sum(raw) for x in raw]


def smoothed(pixels: DataFrame, height: int, width: int, sigma: float = SIGMA) -> DataFrame:
    """`image, r, c, s` of the pixels that are there: the Gaussian mean; beyond the frame the pixels at its edge go on. What an
    image lacks inside its frame counts as 0."""
    weights = _weights(sigma)
    radius = len(weights) // 2
    upto = [sum(weights[:k]) for k in range(len(weights) + 1)]
    w, below = F.array(*[F.lit(x) for x in weights]), F.array(*[F.lit(x) for x in upto])

    def targets(along: str, size: int) -> Column:
        s = F.col(along).cast("int")

        def weight(t: Column) -> Column:
            # All offsets that lead from t to s, those beyond the frame included.
            first = F.element_at(below, F.least(F.greatest(radius + 1 - t, F.lit(0)), F.lit(2 * radius + 1)) + 1)
            last = 1 - F.element_at(below, F.least(F.greatest(radius + size - 1 - t, F.lit(0)), F.lit(2 * radius + 1)) + 1)
            return F.when(s == 0, first).when(s == size - 1, last).otherwise(F.element_at(w, s - t + radius + 1))

        places = F.sequence(F.greatest(s - radius, F.lit(0)), F.least(s + radius, F.lit(size - 1)))
        return F.transform(places, lambda t: F.struct(t.cast("long").alias("at"), weight(t).alias("w")))

    # Places that only neighbours reach are no pixels.
    there = F.max(F.col("there") & (F.col("t.at") == F.col("__from"))).alias("there")
    start = pixels.select(*PLACE, F.col("g").cast("double").alias("s"), F.lit(True).alias("there"))
    return _handed(_handed(start, "c", "s", targets("c", width), there), "r", "s", targets("r", height), there).where("there").select(*PLACE, "s")


def local_mean(pixels: DataFrame, height: int, width: int, reach: int = 2) -> DataFrame:
    """`image, r, c, m`: the mean of a square of 2 * reach + 1 pixels, of those that are there; the image is mirrored at its
    frame. Means along rows first, then those of the rows."""

    def targets(along: str, size: int) -> Column:
        s = F.col(along).cast("int")
        steps = F.array(*[F.lit(k) for k in range(-reach, reach + 1)])
        places = F.flatten(F.transform(steps, lambda k: F.array(s - k, -s - 1 - k, 2 * size - 1 - s - k)))
        inside = F.filter(places, lambda t: (t >= 0) & (t < size))
        return F.transform(inside, lambda t: F.struct(t.cast("long").alias("at"), F.lit(1.0).alias("w")))

    def means(rows: DataFrame, along: str, size: int) -> DataFrame:
        return _handed(rows, along, "m", targets(along, size), F.count(F.lit(1)).alias("n")).select(*PLACE, (F.col("m") / F.col("n")).alias("m"))

    return means(means(pixels.select(*PLACE, F.col("g").cast("double").alias("m")), "c", width), "r", height)


def _with_cross(on: DataFrame) -> DataFrame:
    """`image, r, c, n, own`: for every place how many set pixels its cross of five has, and whether it is one."""
    steps = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))])
    each = on.select("image", "r", "c", F.explode(steps).alias("d"))
    own = (F.col("d.dr") == 0) & (F.col("d.dc") == 0)
    return each.groupBy("image", (F.col("r") + F.col("d.dr")).alias("r"), (F.col("c") + F.col("d.dc")).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.max(own).alias("own"))


def dilated(on: DataFrame, height: int, width: int) -> DataFrame:
    """The set pixels `image, r, c` and their neighbours inside the frame."""
    return _with_cross(on).where(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1)).select(*PLACE)


def eroded(on: DataFrame) -> DataFrame:
    """The set pixels whose four neighbours are set; beyond the frame nothing is."""
    return _with_cross(on).where("n = 5").select(*PLACE)


def otsu(pixels: DataFrame, keys: list[str], levels: int = LEVELS) -> DataFrame:
    """`keys, t1, t2`: the pair of levels that parts the grey values into three classes with the largest variance between
    them, each class up to and with its level; the first pair in order wins. Groups without three levels have none."""
    hist = pixels.groupBy(*keys, "g").agg(F.count(F.lit(1)).cast("double").alias("n"))
    order = Window.partitionBy(*keys).orderBy("g")
    cum = hist.select(*keys, "g", F.sum("n").over(order).alias("w"), F.sum(F.col("n") * F.col("g")).over(order).alias("s"))
    whole = hist.groupBy(*keys).agg(F.sum("n").alias("wt"), F.sum(F.col("n") * F.col("g")).alias("st"))
    one, two = cum.select(*keys, F.col("g").alias("t1"), F.col("w").alias("w1"), F.col("s").alias("s1")), cum.select(*keys, F.col("g").alias("t2"), F.col("w").alias("w2"), F.col("s").alias("s2"))
    pairs = one.join(two.hint("merge"), keys).where("t1 < t2").join(whole.hint("merge"), keys).where("w2 < wt")  # levels squared at most, whatever the image
    gain = F.col("s1") ** 2 / F.col("w1") + (F.col("s2") - F.col("s1")) ** 2 / (F.col("w2") - F.col("w1")) + (F.col("st") - F.col("s2")) ** 2 / (F.col("wt") - F.col("w2"))
    best = F.max(F.struct(F.round(gain, 4).alias("gain"), (-F.col("t1")).alias("a"), (-F.col("t2")).alias("b"))).alias("best")
    return pairs.groupBy(*keys).agg(best).select(*keys, (-F.col("best.a")).alias("t1"), (-F.col("best.b")).alias("t2"))


def shading(pixels: DataFrame, height: int, bands: int = 5) -> DataFrame:
    """`image, drift, flagged`: the largest drift of a threshold over the horizontal bands."""
    band = sum(((F.col("r") >= k * height // bands).cast("int") for k in range(1, bands)), F.lit(0))
    each = otsu(pixels.withColumn("band", band), ["image", "band"])
    drift = F.greatest(*[F.max(t) - F.min(t) for t in ("t1", "t2")]).cast("double")
    return each.groupBy("image").agg(drift.alias("drift")).withColumn("flagged", F.col("drift") > SHADING_LEVELS)


def gates(pixels: DataFrame, height: int, low: int, high: int) -> DataFrame:
    """Acquisition covariates of each image: levels, comb step, saturation, medians of the phases, row gradient."""
    edge = max(height // 8, 1)
    p = phases(low, high)
    g = F.col("g")
    top, bottom, mean = (F.avg(F.when(c, g)) for c in (F.col("r") < edge, F.col("r") >= height - edge, F.lit(True)))
    own = pixels.groupBy("image").agg(
        F.countDistinct("g").alias("n_levels"),
        F.avg((g == 0).cast("double")).alias("sat0"),
        F.avg((g == LEVELS - 1).cast("double")).alias("sat255"),
        F.percentile(F.when(p["carbon"], g), F.lit(0.5)).alias("c_med"),
        F.percentile(F.when(p["si"], g), F.lit(0.5)).alias("si_med"),
        ((top - bottom) / F.greatest(mean, F.lit(1e-6)) * 100).alias("row_gradient_pct"),
    )
    levels = pixels.where(g.between(20, 200)).select("image", "g").distinct()
    steps = levels.withColumn("step", g - F.lag("g").over(Window.partitionBy("image").orderBy("g")))
    comb = steps.groupBy("image").agg(F.when(F.count(F.lit(1)) > 2, F.percentile("step", F.lit(0.5))).alias("comb_step"))
    return own.join(comb, "image", "left")


def noise(pixels: DataFrame, height: int, width: int, low: int, high: int) -> DataFrame:
    """`image, noise_sd`: the deviation of carbon pixels from the mean of the 25 around them."""
    rest = local_mean(pixels, height, width).join(pixels.where(phases(low, high)["carbon"]), PLACE)
    return rest.groupBy("image").agg(F.stddev_pop(F.col("g") - F.col("m")).alias("noise_sd"))


def majority(pixels: DataFrame, factor: int, label: Column, labels: int, height: int, width: int) -> DataFrame:
    """`image, br, bc, label` of each full block: the most frequent of labels 0 to labels - 1, or `labels` on a tie."""
    full = (F.col("r") < height // factor * factor) & (F.col("c") < width // factor * factor)
    votes = pixels.where(full).groupBy("image", F.floor(F.col("r") / factor).alias("br"), F.floor(F.col("c") / factor).alias("bc")).agg(*[F.count(F.when(label == k, 1)).alias(f"v{k}") for k in range(labels)])
    most = F.greatest(*[F.col(f"v{k}") for k in range(labels)])
    ties = sum(((F.col(f"v{k}") == most).cast("int") for k in range(labels)), F.lit(0))
    chosen = F.lit(labels)
    for k in range(labels):
        chosen = F.when((ties == 1) & (F.col(f"v{k}") == most), k).otherwise(chosen)
    return votes.select("image", "br", "bc", chosen.cast("long").alias("label"))


def downsampled(pixels: DataFrame, factor: int) -> DataFrame:
    """The mean of each block as a pixel; blocks at the frame have those pixels that are there."""
    return pixels.groupBy("image", F.floor(F.col("r") / factor).alias("r"), F.floor(F.col("c") / factor).alias("c")).agg(F.avg("g").alias("g"))


def masked(pixels: DataFrame, masks: DataFrame) -> DataFrame:
    """The pixels outside the rows and columns that `masks` (image, kind, lo, hi) excludes, ends included."""
    at = F.when(F.col("kind") == "rows", F.col("r")).otherwise(F.col("c"))
    hit = pixels.join(F.broadcast(masks), "image").where(at.between(F.col("lo"), F.col("hi"))).select(*PLACE)  # written by hand, so few
    return pixels.join(hit.distinct(), PLACE, "left_anti")


def fused(pixels: DataFrame, low: int, high: int, width: float = 3.0, trust: float = 0.7) -> DataFrame:
    """Pixels `image, r, c, g, e` with `middle` (0 pore, 1 carbon, 2 silicon), `unsure` and `conflict`: Dempster's rule
    over a channel that commits itself to pores, and by `trust` to carbon, and one that keeps a tenth for either."""
    ground = pixels.groupBy("image").agg(F.percentile("e", F.lit(0.02)).alias("floor"), F.percentile(F.when(phases(low, high)["carbon"], F.col("e")), F.lit(0.5)).alias("ground"))
    both = pixels.join(ground, "image")
    first = 1 / (1 + F.exp((F.col("g") - low) / width))
    scaled = (F.col("e") - F.col("floor")) / F.greatest(F.col("ground") - F.col("floor"), F.lit(1e-6))
    dark = 1 / (1 + F.exp((scaled - 0.5) / 0.1))
    out = both.withColumns({"ap": first, "bp": 0.9 * dark})
    out = out.withColumns({"ac": trust * (1 - F.col("ap")), "any": (1 - trust) * (1 - F.col("ap")), "bc": 0.9 - F.col("bp")})
    out = out.withColumn("conflict", F.col("ap") * F.col("bc") + F.col("ac") * F.col("bp"))
    left = F.greatest(1 - F.col("conflict"), F.lit(1e-6))
    half = 0.05 * F.col("any")
    out = out.withColumns({"for_pore": (F.col("ap") * (F.col("bp") + 0.1) + F.col("any") * F.col("bp") + half) / left, "for_carbon": (F.col("ac") * (F.col("bc") + 0.1) + F.col("any") * F.col("bc") + half) / left})
    silicon = F.col("g") >= high
    weak = (F.greatest("for_pore", "for_carbon") < 0.6) & (F.abs(F.col("for_pore") - F.col("for_carbon")) < 0.2)
    middle = F.when(silicon, 2).when(F.col("for_pore") >= F.col("for_carbon"), 0).otherwise(1)
    return out.select(*PLACE, "g", middle.cast("long").alias("middle"), ((weak | (F.col("conflict") > 0.3)) & ~silicon).alias("unsure"), "conflict")


def squared_distances(on: DataFrame, off: DataFrame) -> DataFrame:
    """`image, r, c, d2`: the squared distance of every set pixel to the nearest unset one of its image; an image without an
    unset pixel has no rows. What the nearest rows with an unset pixel have along them bounds the rows that have to be
    looked at, so a pixel asks about as many rows as it is deep."""
    all_ = on.withColumn("at", F.lit(None).cast("long")).unionByName(off.withColumn("at", F.col("c")))
    line = Window.partitionBy("image", "r").orderBy("c")
    before = F.last("at", ignorenulls=True).over(line)
    after = F.first("at", ignorenulls=True).over(line.rowsBetween(0, Window.unboundedFollowing))
    rows = all_.select(*PLACE, F.least(F.col("c") - before, after - F.col("c")).alias("h"), F.col("at").isNull().alias("on"))
    column = Window.partitionBy("image", "c").orderBy("r")
    below = column.rowsBetween(0, Window.unboundedFollowing)

    def nearest(found: Column) -> Column:
        """How far the unset pixel along the nearest row with `found` is at most, by steps along rows and columns."""
        place = F.when(found, F.struct("r", "h"))
        up, down = F.last(place, ignorenulls=True).over(column), F.first(place, ignorenulls=True).over(below)
        return F.least(F.col("r") - up["r"] + up["h"], down["r"] - F.col("r") + down["h"])

    reach = F.least("h", nearest(F.col("h") == 0), nearest(F.col("h").isNotNull()))
    bounded = rows.withColumn("reach", reach).where("on AND reach IS NOT NULL")
    asked = bounded.select(*PLACE, F.explode(F.sequence(F.col("r") - F.col("reach") + 1, F.col("r") + F.col("reach") - 1)).alias("q"), "reach")
    other = rows.select("image", F.col("r").alias("q"), "c", "h")
    found = asked.join(other, ["image", "q", "c"], "left").groupBy(*PLACE).agg(F.least(F.min(F.col("h") ** 2 + (F.col("r") - F.col("q")) ** 2), F.max(F.col("reach") ** 2)).alias("d2"))
    return found.select(*PLACE, F.col("d2").cast("long").alias("d2"))


def eroded_times(on: DataFrame, times: int) -> DataFrame:
    for _ in range(times):
        on = eroded(on)
    return on


def dilated_times(on: DataFrame, height: int, width: int, times: int) -> DataFrame:
    for _ in range(times):
        on = dilated(on, height, width)
    return on


def core_median(pixels: DataFrame, mask: DataFrame, times: int, name: str, least: int = 50) -> DataFrame:
    """`image, name`: the median level inside the mask eroded a few times, or in all of it if too little is left."""
    own = mask.join(pixels, PLACE)
    core = eroded_times(mask, times).withColumn("core", F.lit(True))
    both = own.join(core, PLACE, "left").groupBy("image").agg(F.count("core").alias("n"), F.percentile(F.when(F.col("core"), F.col("g")), F.lit(0.5)).alias("inner"), F.percentile("g", F.lit(0.5)).alias("whole"))
    return both.select("image", F.when(F.col("n") >= least, F.col("inner")).otherwise(F.col("whole")).alias(name))


def edge_runs(flags: DataFrame, size: int, most: int | None = None) -> DataFrame:
    """`image, first, last, inner` of the flagged positions `image, at`: how many in a row at either end (none if more
    than `most`), and how many others. If all positions are flagged, they count to the first end."""
    order = Window.partitionBy("image").orderBy("at")
    back = Window.partitionBy("image").orderBy(F.desc("at"))
    placed = flags.withColumns({"__a": F.row_number().over(order) - 1, "__b": F.row_number().over(back) - 1})
    each = placed.groupBy("image").agg(F.count(F.when(F.col("__a") == F.col("at"), 1)).alias("first"), F.count(F.when(F.col("__b") == size - 1 - F.col("at"), 1)).alias("last"), F.count(F.lit(1)).alias("n"))
    each = each.withColumn("last", F.when(F.col("first") < F.col("n"), F.col("last")).otherwise(0))
    limit = size if most is None else most
    return each.select("image", *[F.when(F.col(c) <= limit, F.col(c)).otherwise(0).alias(c) for c in ("first", "last")], (F.col("n") - F.col("first") - F.col("last")).alias("inner"))


def bad_columns(pixels: DataFrame) -> DataFrame:
    """`image, at` of the columns in most of whose pixels the colours `g, red, blue` differ."""
    differ = (F.col("red") != F.col("g")) | (F.col("blue") != F.col("g"))
    return pixels.groupBy("image", F.col("c").alias("at")).agg(F.avg(differ.cast("double")).alias("share")).where("share > 0.5").select("image", "at")


def edge_bands(pixels: DataFrame, height: int, width: int, dark: float, rough: float) -> DataFrame:
    """`image, at` of the rows in a band that is dark in `g` and locally rough in `e`, by the mean of the flags of nine rows
    (mirrored at the frame)."""
    second = pixels.select(*PLACE, F.col("e").alias("g"))
    square = pixels.select(*PLACE, (F.col("e") * F.col("e")).alias("g"))
    local = local_mean(square, height, width).withColumnRenamed("m", "q").join(local_mean(second, height, width), PLACE).withColumn("v", F.round(F.col("q") - F.col("m") ** 2, 6))
    both = pixels.join(local, PLACE)
    half = F.lit(0.5)
    whole = both.groupBy("image").agg(F.percentile("g", half).alias("gm"), F.percentile("v", half).alias("vm"))
    rows = both.groupBy("image", "r").agg(F.percentile("g", half).alias("rg"), F.percentile("v", half).alias("rv")).join(whole, "image")
    flags = rows.select("image", "r", F.lit(0).cast("long").alias("c"), ((F.col("rg") < dark * F.col("gm")) & (F.col("rv") > rough * F.col("vm"))).cast("double").alias("m"))
    s = F.col("r").cast("int")
    places = F.flatten(F.transform(F.array(*[F.lit(k) for k in range(-4, 5)]), lambda k: F.array(s - k, -s - 1 - k, 2 * height - 1 - s - k)))
    targets = F.transform(F.filter(places, lambda t: (t >= 0) & (t < height)), lambda t: F.struct(t.cast("long").alias("at"), F.lit(1.0 / 9).alias("w")))
    return _handed(flags, "r", "m", targets).where(F.round("m", 9) > 0.5).select("image", F.col("r").alias("at"))


def without_islands(labels: DataFrame, small: DataFrame, height: int, width: int) -> DataFrame:
    """`image, r, c, label, own`: pixels `small` (image, r, c) of a label map (label 0 pore, 1 carbon, 2 silicon) take the most
    frequent label of the 25 around them that are not small, silicon counting as carbon; `own` is the label before."""
    marked = labels.join(small.withColumn("small", F.lit(True)), PLACE, "left")
    out = marked
    for k in range(3):
        votes = local_mean(marked.select(*PLACE, ((F.col("label") == k) & F.col("small").isNull()).cast("int").alias("g")), height, width)
        out = out.join(votes.select(*PLACE, F.round(F.col("m") * 25).alias(f"v{k}")), PLACE)
    most = F.greatest("v0", "v1", "v2")
    chosen = F.when(F.col("v0") == most, 0).otherwise(1)
    return out.select(*PLACE, F.when(F.col("small"), chosen).otherwise(F.col("label")).cast("long").alias("label"), F.col("label").alias("own"))
