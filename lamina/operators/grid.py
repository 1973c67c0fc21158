"""Operators on rasters given as rows `row, col, on` or as runs `row, first, last` of set pixels.

Everything that can works on runs, which are far fewer than pixels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.tables import stored, with_workers

#: Positions of a line that one task looks at together, and columns of a bucket in which runs look for neighbours.
PART = 4096
BUCKET = 256
#: Rows of a tile whose runs one call labels: 128 times half of PART at most, whatever the raster.
TILE_ROWS = 128


def runs(pixels: DataFrame, line: str = "row", at: str = "col") -> DataFrame:
    """`line, first, last` of each maximal run of set pixels along a line: pixels of a run share the difference of
    position and rank. Lines are cut into parts first, so that a few long lines fill many tasks; only the runs at the
    ends of parts, two a part, have to be put together again."""
    rank = F.row_number().over(Window.partitionBy(line, "__part").orderBy(at))
    cut = pixels.where("on").withColumn("__part", F.floor(F.col(at) / PART))
    each = cut.withColumn("__g", F.col(at) - rank).groupBy(line, "__part", "__g").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    open_ = (F.pmod("first", F.lit(PART)) == 0) | (F.pmod(F.col("last") + 1, F.lit(PART)) == 0)
    ordered = Window.partitionBy(line).orderBy("first")
    starts = F.coalesce((F.col("first") != F.lag("last").over(ordered) + 1).cast("int"), F.lit(1))
    ends = each.where(open_).withColumn("__new", starts).withColumn("__run", F.sum("__new").over(ordered))
    whole = ends.groupBy(line, "__run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return each.where(~open_).select(line, "first", "last").unionByName(whole.select(line, "first", "last"))


def chords(pixels: DataFrame, line: str, at: str, size: int | None = None) -> DataFrame:
    """`line, first, length` of the runs that don't touch the frame; the frame's end is the largest position."""
    end = pixels.agg(F.max(at).alias("end")) if size is None else pixels.sparkSession.range(1).select(F.lit(size - 1).alias("end"))
    inner = runs(pixels, line, at).crossJoin(F.broadcast(end)).where("first > 0 AND last < end")  # one row
    return inner.select(line, "first", (F.col("last") - F.col("first") + 1).cast("long").alias("length"))


def fractions(pixels: DataFrame, keys: list[str]) -> DataFrame:
    return pixels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("on").cast("double")).alias("fraction"))


def quadrat_cv(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """`n, mean, cv` of the set fraction over quadrats that are full; the deviation is that of the population."""
    cells = pixels.groupBy(F.floor(F.col("row") / height).alias("qr"), F.floor(F.col("col") / width).alias("qc")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("on").cast("double")).alias("f"))
    return cells.where(F.col("n") == height * width).agg(F.count(F.lit(1)).alias("n"), F.avg("f").alias("mean"), F.try_divide(F.stddev_pop("f"), F.avg("f")).alias("cv"))


def band_slope(pixels: DataFrame, bands: int = 5) -> DataFrame:
    """`slope, intercept` of the set fraction over the number of the band, of equal bands down the raster."""
    height = pixels.agg((F.max("row") + 1).alias("h"))
    placed = pixels.crossJoin(F.broadcast(height)).withColumn("band", F.least(_band(F.col("row"), F.col("h"), bands), F.lit(bands - 1)))
    each = placed.groupBy("band").agg(F.avg(F.col("on").cast("double")).alias("f"))
    return each.agg(F.regr_slope("f", F.col("band").cast("double")).alias("slope"), F.regr_intercept("f", F.col("band").cast("double")).alias("intercept"))


def _band(row, height, bands: int):
    """The largest k with k * height // bands <= row."""
    return F.floor(((row + 1) * bands - 1) / height)


def block_majority(pixels: DataFrame, factor: int = 4) -> DataFrame:
    """`br, bc, label`: 1 or 0 by majority of each block, 3 (uncertain) on a tie."""
    each = pixels.groupBy(F.floor(F.col("row") / factor).alias("br"), F.floor(F.col("col") / factor).alias("bc")).agg(F.sum(F.col("on").cast("int")).alias("s"), F.count(F.lit(1)).alias("n"))
    return each.select("br", "bc", F.when(2 * F.col("s") > F.col("n"), 1).when(2 * F.col("s") == F.col("n"), 3).otherwise(0).cast("long").alias("label"))


def euler_number(pixels: DataFrame) -> DataFrame:
    """`euler` of the set pixels under 4-connection: vertices - edges + faces over pixels, pairs and full squares."""
    on = pixels.where("on").select("row", "col")
    squares = on.withColumn("part", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for k, dr, dc in _PARTS])))
    placed = squares.select((F.col("row") - F.col("part.dr")).alias("r"), (F.col("col") - F.col("part.dc")).alias("c"), F.col("part.k").alias("k"))
    complete = placed.groupBy("r", "c", "k").count().where(F.col("count") == F.element_at(F.array(F.lit(1), F.lit(2), F.lit(2), F.lit(4)), F.col("k")))
    sign = F.when(F.col("k").isin(2, 3), -1).otherwise(1)
    return complete.agg(F.coalesce(F.sum(sign), F.lit(0)).cast("long").alias("euler"))


#: Pixel, horizontal pair, vertical pair, square: kind and offsets of their pixels.
_PARTS = [(1, 0, 0), (2, 0, 0), (2, 0, 1), (3, 0, 0), (3, 1, 0), (4, 0, 0), (4, 0, 1), (4, 1, 0), (4, 1, 1)]


def _label_tile(rows: pd.DataFrame, reach: int, height: int, width: int) -> pd.DataFrame:
    """The runs of a tile of `height` rows and `width` columns with their `part`, the smallest node that a run is connected with inside the tile, and whether that
    part is `open`: it has a run in the tile's first or last row, or one that other tiles have as well. A run is the tile's `own` if it starts there."""
    rows = rows.sort_values("node", ignore_index=True)
    row, first, last = (rows[c].to_numpy() for c in ("row", "first", "last"))
    line = int(last.max() - first.min()) + 3
    starts, ends = row * line + first - first.min(), row * line + last - first.min()
    low = np.searchsorted(ends, starts + line - reach, "left")
    n = np.maximum(np.searchsorted(starts, ends + line + reach, "right") - low, 0)
    up = np.repeat(np.arange(len(rows)), n)
    down = np.arange(len(up)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    root = np.arange(len(rows))
    while True:
        a, b = root[up], root[down]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    edge = (row % height == 0) | (row % height == height - 1) | (first // width != (last + reach) // width)
    open_ = np.zeros(len(rows), bool)
    open_[root[edge]] = True
    return rows[["row", "first", "last", "node"]].assign(part=rows["node"].to_numpy()[root], open=open_[root], own=first // width == rows["__across"].to_numpy())


def _linked(edges: DataFrame) -> DataFrame:
    """`node, label` of the nodes of `edges` (node, other; both ways): the smallest node that can be reached. Labels sink to
    the smallest neighbour and jump along their own labels; each round is stored. Labels grow with the raster, so joins are by merge."""
    labels = edges.select("node").distinct().select("node", F.col("node").alias("label"))
    while True:
        near = edges.join(labels.select(F.col("node").alias("other"), "label").hint("merge"), "other").groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(near.hint("merge"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.join(labels.select(F.col("node").alias("label"), F.col("label").alias("next")).hint("merge"), "label")
        new = stored(jump.select("node", "old", F.least("label", "next").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("old != label").isEmpty():
            return labels


def components(pixels: DataFrame, diagonal: bool = False) -> DataFrame:
    """`row, first, last, component` of every run, connected along four directions, or eight with `diagonal`: the
    smallest run number (row * 2^32 + first) that can be reached. Tiles of TILE_ROWS rows and PART columns are labelled
    each on its own; what goes through rounds of joins is only their parts that reach a tile's edge."""
    node = F.col("row").cast("long") * F.lit(2**32) + F.col("first").cast("long")
    # A run is in every tile that it, or with `diagonal` the place behind it, has a column in, so that of two runs that touch
    # within the rows of a tile some tile has both.
    reach = int(diagonal)
    line = runs(pixels).select(*[F.col(c).cast("long").alias(c) for c in ("row", "first", "last")], node.alias("node"))
    tiles = line.withColumn("__across", F.explode(F.sequence(F.floor(F.col("first") / PART), F.floor((F.col("last") + reach) / PART))))
    grouped = tiles.groupBy(F.floor(F.col("row") / TILE_ROWS).alias("__down"), "__across")
    with_workers(pixels.sparkSession)
    height, width = TILE_ROWS, PART
    found = grouped.applyInPandas(lambda rows: _label_tile(rows, reach, height, width), "row long, first long, last long, node long, part long, open boolean, own boolean")
    labelled = stored(found, "tiles")
    # Parts of different tiles belong together by a run that both have, or by runs that touch across rows; these look for
    # neighbours in buckets of columns, and of the buckets that two runs share, the one where the later of them starts counts.
    open_ = labelled.where("open")

    def bucketed(rows: DataFrame, first: str, last: str) -> DataFrame:
        return rows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(first) / BUCKET), F.floor(F.col(last) / BUCKET))))

    at = F.pmod("row", F.lit(TILE_ROWS))
    here = bucketed(open_.where(at == TILE_ROWS - 1).select("row", "first", (F.col("last") + reach).alias("end"), F.col("part").alias("node")), "first", "end")
    below = bucketed(open_.where(at == 0).select((F.col("row") - 1).alias("row"), F.col("first").alias("f2"), (F.col("last") + reach).alias("l2"), F.col("part").alias("other")), "f2", "l2")
    overlap = (F.col("first") <= F.col("l2")) & (F.col("f2") <= F.col("end")) & (F.col("bucket") == F.floor(F.greatest("first", "f2") / BUCKET))
    touch = here.join(below.hint("merge"), ["row", "bucket"]).where(overlap).select("node", "other")
    wide = open_.where(F.floor(F.col("first") / PART) != F.floor((F.col("last") + reach) / PART))
    shared = wide.select(F.col("node").alias("run"), F.col("part").alias("node")).join(wide.groupBy(F.col("node").alias("run")).agg(F.min("part").alias("other")).hint("merge"), "run").select("node", "other")
    links = touch.unionByName(shared).where("node != other")
    edges = stored(links.unionByName(links.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    whole = _linked(edges).withColumnRenamed("node", "part")
    # A run of several tiles is given once, by the tile of its first column; all its parts have the same label.
    closed = labelled.where("NOT open").select("row", "first", "last", F.col("part").alias("component"))
    joined = open_.where("own").join(whole.hint("merge"), "part", "left").select("row", "first", "last", F.coalesce("label", "part").alias("component"))
    return closed.unionByName(joined)


def component_sizes(labelled: DataFrame) -> DataFrame:
    """`component, n_runs, n_pixels, top, bottom, left, right`."""
    return labelled.groupBy("component").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.sum(F.col("last") - F.col("first") + 1).cast("long").alias("n_pixels"),
        F.min("row").cast("long").alias("top"),
        F.max("row").cast("long").alias("bottom"),
        F.min("first").cast("long").alias("left"),
        F.max("last").cast("long").alias("right"),
    )


def percolation(sizes: DataFrame, height: int, width: int) -> DataFrame:
    """`n_pixels, across, down`: share of set pixels in components that touch both sides of the raster."""
    across, down = (F.col("left") == 0) & (F.col("right") == width - 1), (F.col("top") == 0) & (F.col("bottom") == height - 1)
    share = [F.try_divide(F.coalesce(F.sum(F.when(c, F.col("n_pixels"))), F.lit(0)).cast("double"), F.sum("n_pixels").cast("double")) for c in (across, down)]
    return sizes.agg(F.sum("n_pixels").cast("long").alias("n_pixels"), share[0].alias("across"), share[1].alias("down"))


def nearest(points: DataFrame, cell: float) -> DataFrame:
    """`id, d`: distance to the nearest other point of `id, x, y`. A point looks into its own and the eight cells
    around; one whose nearest lies further than a cell's width, or who finds none, gets the next ring of cells, so
    the answer is exact however wide the cells are."""
    placed = stored(points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")), "points")
    other = placed.select(F.col("id").alias("oid"), F.col("x").alias("ox"), F.col("y").alias("oy"), "cx", "cy")
    span = placed.agg(F.max("cx") - F.min("cx"), F.max("cy") - F.min("cy"), F.count(F.lit(1))).first()
    todo, done, ring = placed, None, 1
    while True:
        steps = F.array(*[F.lit(k) for k in range(-ring, ring + 1)])
        wide = todo.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps)).select("id", "x", "y", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
        d = F.sqrt((F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2)
        found = wide.join(other, ["cx", "cy"]).where("id != oid").groupBy("id").agg(F.min(d).alias("d"))
        last = ring > max(span[0] or 0, span[1] or 0)
        sure = stored(found if last else found.where(F.col("d") <= ring * cell), "nearest")
        done = sure if done is None else done.unionByName(sure)
        if last:
            return done
        todo = stored(todo.join(sure, "id", "left_anti"), "points")
        if todo.isEmpty():
            return done
        ring *= 2


def clark_evans(points: DataFrame, area: float, perimeter: float, cell: float) -> DataFrame:
    """`n, mean_d, r`: mean nearest-neighbour distance over that of random points with the edge correction; null
    below five points."""
    near = nearest(points, cell).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_d"))
    n = F.col("n").cast("double")
    expected = 0.5 * F.sqrt(area / n) + (0.0514 + 0.041 / F.sqrt(n)) * perimeter / n
    return near.select("n", "mean_d", F.when(F.col("n") >= 5, F.col("mean_d") / expected).alias("r"))


def binned_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """`keys, value`: the median of a quantised variable, linear within the bin that holds it. Bins end half way
    between neighbouring levels; the outer ones are as wide as the step next to them."""
    w = Window.partitionBy(*keys).orderBy(value)
    levels = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).cast("double").alias("c"))
    placed = levels.withColumns({"prev": F.lag(value).over(w), "next": F.lead(value).over(w), "cum": F.sum("c").over(w) / F.sum("c").over(Window.partitionBy(*keys))})
    v = F.col(value)
    low = F.coalesce((F.col("prev") + v) / 2, v - (F.col("next") - v) / 2, v)
    high = F.coalesce((v + F.col("next")) / 2, v + (v - F.col("prev")) / 2, v)
    before = F.coalesce(F.lag("cum").over(w), F.lit(0.0))
    bins = placed.select(*keys, low.alias("lo"), high.alias("hi"), before.alias("c0"), "cum").where("cum >= 0.5 AND c0 < 0.5")
    return bins.select(*keys, (F.col("lo") + (0.5 - F.col("c0")) / (F.col("cum") - F.col("c0")) * (F.col("hi") - F.col("lo"))).alias("value"))


def weighted_histogram(rows: DataFrame, value: str, weight: str, lo: float, hi: float, bins: int) -> DataFrame:
    """`bin, total` over equal bins from lo to hi; the last bin has its right end, values outside are left out."""
    at = F.least(F.floor((F.col(value) - lo) / ((hi - lo) / bins)), F.lit(bins - 1))
    return rows.where(F.col(value).between(lo, hi)).groupBy(at.alias("bin")).agg(F.sum(weight).alias("total"))
