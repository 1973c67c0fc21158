"""Local thickness of masks: the largest disk inside a mask that covers a pixel.

Masks are cut into tiles, each with a margin of twice the largest radius: whatever decides about a pixel lies within that.
A tile is one call of an array kernel, so a task holds a tile and its margin at most, however large the image, and a
pixel moves once, or once for each tile whose margin it is in.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.tables import spread, with_workers
from lamina.operators import grey as Y

#: Radii of the disks in pixels of the coarse mask, and the step of that mask.
RADII = [*range(1, 21), *range(22, 41, 2), 45, 50, 60, 70, 80, 100]
FACTOR = 2
#: Coarse places along the side of a tile, without its margin.
TILE = 512


def _near(places: np.ndarray, reach: int) -> np.ndarray:
    """The squared distance of each place of an array to the nearest set one, and more than `reach` squared where none is near."""
    at = np.arange(places.shape[1])
    far = len(at) + reach + 1
    before = np.maximum.accumulate(np.where(places, at, -far), axis=1)
    after = np.minimum.accumulate(np.where(places, at, 2 * far)[:, ::-1], axis=1)[:, ::-1]
    along = np.minimum(np.minimum(at - before, after - at), reach + 1) ** 2
    out = along.copy()
    for k in range(1, min(reach, len(places) - 1) + 1):
        np.minimum(out[k:], along[:-k] + k * k, out=out[k:])
        np.minimum(out[:-k], along[k:] + k * k, out=out[:-k])
    return out


def _widest(on: np.ndarray, off: np.ndarray, radii: list[int]) -> np.ndarray:
    """The largest radius with a disk without a place of `off` closer than it to its centre in `on` that reaches a place, or 0."""
    depth = np.where(on, _near(off, radii[-1]), 0)
    out = np.zeros(on.shape, np.int64)
    for k in radii:
        centres = depth >= k * k
        if not centres.any():
            break
        out[_near(centres, k) <= k * k] = k
    return out


def _measure_tile(rows: pd.DataFrame, factor: int, radii: list[int], tile: int, sides: tuple[bool, ...]) -> pd.DataFrame:
    """The tile's own pixels of `sides` with their `t`; the others are its margin."""
    br, bc, on = rows["r"].to_numpy() // factor, rows["c"].to_numpy() // factor, rows["on"].to_numpy(bool)
    own = ((br + 2 * radii[-1]) // tile == rows["down"].to_numpy()) & ((bc + 2 * radii[-1]) // tile == rows["across"].to_numpy())
    coarse = ((rows["r"] % factor == 0) & (rows["c"] % factor == 0)).to_numpy()
    br, bc = br - br.min(), bc - bc.min()
    masks = np.zeros((2, br.max() + 1, bc.max() + 1), bool)
    masks[on[coarse].astype(int), br[coarse], bc[coarse]] = True
    t, asked = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
    for side in sides:
        mine = own & (on == side)
        if mine.any():
            this, other = masks[int(side)], masks[int(not side)]
            found = np.where(this, np.maximum(2 * factor * _widest(this, other, radii), factor), 0)
            t[mine] = found[br[mine], bc[mine]]
            asked |= mine
    return rows[asked].assign(t=t[asked])


def _coarse(factor: int) -> Column:
    return (F.pmod("r", F.lit(factor)) == 0) & (F.pmod("c", F.lit(factor)) == 0)


def _own(at: str, factor: int, margin: int) -> Column:
    """The number of the tile that a row or column lies in. Tiles begin a margin before 0, so that an image of at most TILE less
    two margins a side lies in one and in no other's margin."""
    return F.floor((F.floor(F.col(at) / factor) + margin) / TILE)


def _tiles(pixels: DataFrame, factor: int, margin: int) -> DataFrame:
    """`pixels` by tile: each in its own, and those at coarse places in all tiles whose margin has them as well."""

    def across(at: str) -> Column:
        place = F.floor(F.col(at) / factor)
        near = F.sequence(F.floor(place / TILE), F.floor((place + 2 * margin) / TILE))
        return F.explode(F.when(_coarse(factor), near).otherwise(F.array(_own(at, factor, margin))))

    placed = pixels.select("image", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "on")
    return placed.withColumn("down", across("r")).withColumn("across", across("c"))


def _bounded(pixels: DataFrame, factor: int, margin: int) -> DataFrame:
    """`image, down, across, on` of the tiles and sides of an image that a coarse place of the other side bounds, in whichever tile."""
    tiles = pixels.groupBy("image", _own("r", factor, margin).alias("down"), _own("c", factor, margin).alias("across"))
    has = tiles.agg(*[F.max(_coarse(factor) & (F.col("on") == side)).alias(name) for side, name in ((True, "set"), (False, "unset"))])
    whole = Window.partitionBy("image")
    sides = F.array(*[F.struct(F.lit(side).alias("on"), F.max(name).over(whole).alias("by")) for side, name in ((True, "unset"), (False, "set"))])
    return has.withColumn("sides", sides).select("image", "down", "across", F.explode("sides").alias("s")).where("s.by").select("image", "down", "across", "s.on")


def both_sides(pixels: DataFrame, factor: int = FACTOR, radii: list[int] = RADII, sides: tuple[bool, ...] = (True, False)) -> DataFrame:
    """`image, r, c, on, t` of pixels `image, r, c, on`: local thickness of a mask and, as a mask of its own, of the other pixels
    of its image, or of one of these `sides`. See `local_thickness`."""
    if not radii or sorted(set(radii)) != list(radii) or radii[0] < 1 or len(radii) > 62:
        raise ValueError("radii must ascend from 1 or more and number at most 62")
    with_workers(pixels.sparkSession)
    tile, margin, keys = TILE, 2 * radii[-1], ["image", "down", "across"]
    known = pixels.dropna(subset=Y.PLACE)
    shape = f"image {pixels.schema['image'].dataType.simpleString()}, r long, c long, on boolean, down long, across long, t long"
    grouped = spread(_tiles(known, factor, margin), keys).groupBy(*keys)
    found = grouped.applyInPandas(lambda rows: _measure_tile(rows, factor, radii, tile, sides), shape)
    # By tile, not by image alone, so that the pixels of a large image do not meet in one task.
    bounded = _bounded(known, factor, margin).withColumn("bounded", F.lit(True))
    return found.join(bounded.hint("merge"), [*keys, "on"], "left").select(*Y.PLACE, "on", F.when(F.col("bounded"), F.col("t").cast("double")).alias("t"))


def local_thickness(on: DataFrame, off: DataFrame, factor: int = FACTOR, radii: list[int] = RADII) -> DataFrame:
    """`image, r, c, t`: thickness in pixels of every pixel `image, r, c` of a mask, from every `factor`-th row and column of it;
    `off` has the other pixels. It is the diameter of the largest disk, `factor` where not even the smallest fits, 0 for a pixel
    whose coarse place is not of the mask, and null in an image of whose coarse places all are: nothing bounds it."""
    pixels = on.select(*Y.PLACE, F.lit(True).alias("on")).unionByName(off.where(_coarse(factor)).select(*Y.PLACE, F.lit(False).alias("on")))
    return both_sides(pixels, factor, radii, (True,)).select(*Y.PLACE, "t")
