"""Distances and local thickness of drawn masks, against every pair of pixels."""

import numpy as np
import pytest

from lamina.operators import grey as Y
from lamina.operators import thickness as T

PLACES = "image long, r long, c long"


def frames(spark, masks):
    rows = {True: [], False: []}
    for k, mask in masks.items():
        for r, c in np.ndindex(mask.shape):
            rows[bool(mask[r, c])].append((k, r, c))
    return spark.createDataFrame(rows[True], PLACES), spark.createDataFrame(rows[False], PLACES)


def drawn():
    rng = np.random.default_rng(3)
    r, c = np.indices((41, 50))
    corner = np.ones((41, 50), bool)
    corner[0, 0] = False
    disks = ((r - 14) ** 2 + (c - 14) ** 2 <= 100) | ((r - 30) ** 2 + (c - 36) ** 2 <= 49) | (abs(r - 20) < 2)
    return {0: rng.random((41, 50)) < 0.8, 1: corner, 2: disks, 5: np.ones((41, 50), bool), 7: np.zeros((41, 50), bool)}


def squared(mask):
    """Squared distance of every set pixel to the nearest unset one, by all pairs."""
    off = np.argwhere(~mask)
    out = np.zeros(mask.shape)
    for p in np.argwhere(mask):
        out[tuple(p)] = ((off - p) ** 2).sum(1).min() if len(off) else np.nan
    return out


def thickness(mask, factor, radii):
    small = mask[::factor, ::factor]
    depth = squared(small)
    out = np.where(small, float(factor), 0.0)
    places = np.indices(small.shape)
    for k in radii:
        for q in np.argwhere(depth >= k * k):
            near = (places[0] - q[0]) ** 2 + (places[1] - q[1]) ** 2 <= k * k
            out[near & small] = 2 * k * factor
    if small.all():
        out[:] = np.nan
    return np.repeat(np.repeat(out, factor, 0), factor, 1)[: mask.shape[0], : mask.shape[1]]


def test_distances(spark):
    masks = drawn()
    got = Y.squared_distances(*frames(spark, masks)).collect()
    want = {}
    for k, m in masks.items():
        if not m.all():
            d = squared(m)
            want |= {(k, r, c): d[r, c] for r, c in map(tuple, np.argwhere(m).tolist())}
    assert {(x["image"], x["r"], x["c"]): x["d2"] for x in got} == want


@pytest.mark.parametrize(("factor", "radii"), [(1, T.RADII), (2, T.RADII), (1, [1, 3, 8, 9])])
def test_thickness(spark, factor, radii):
    masks = drawn()
    got = T.local_thickness(*frames(spark, masks), factor, radii).collect()
    assert len(got) == sum(int(m.sum()) for m in masks.values())
    want = {k: thickness(m, factor, radii) for k, m in masks.items()}
    for x in got:
        w = want[x["image"]][x["r"], x["c"]]
        assert x["t"] is None if np.isnan(w) else x["t"] == w


def test_radii_are_checked(spark):
    on, off = frames(spark, {0: np.eye(3, dtype=bool)})
    for wrong in ([2, 1], [1, 1], list(range(1, 64))):
        with pytest.raises(ValueError):
            T.local_thickness(on, off, 1, wrong)
