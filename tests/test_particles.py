"""Shapes of drawn particles against their definition and against known figures, and perturbation against each pixel."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import grid as G
from lamina.operators import image as I
from lamina.operators import particles as P
from lamina.operators import perturb as M
from lamina.operators import shapes as K


def measured(spark, mask, least=1):
    rows = spark.createDataFrame([(int(r), int(c), True) for r, c in np.argwhere(mask)], "row long, col long, on boolean")
    return sorted(P.shapes(G.components(rows), least).collect(), key=lambda x: x["component"])


def disk(size, centre, radius):
    r, c = np.indices(size)
    return (r - centre[0]) ** 2 + (c - centre[1]) ** 2 <= radius**2


def test_known_figures(spark):
    mask = disk((130, 700), (60, 60), 40)
    mask[100:104, 200:690] = True  # wider than a bucket of columns
    mask[20:22, 300:302] = True
    mask[10:60, 400] = True
    got = {x["n"]: x for x in measured(spark, mask)}
    assert len(got) == 4
    round_ = got[int(disk((130, 700), (60, 60), 40).sum())]
    assert round_["ecd"] == pytest.approx(80, rel=0.01) and round_["aspect"] == pytest.approx(1, abs=0.01)
    assert 0.95 < round_["solidity"] < 1 and 0.9 < round_["circularity"] < 1.1 and (round_["row"], round_["col"]) == (60, 60)
    bar = got[1960]
    assert bar["aspect"] == pytest.approx(490 / 4) and bar["direction"] == 0 and bar["solidity"] == 1
    assert got[50]["direction"] == 90 and got[50]["aspect"] == pytest.approx(50)


def test_any_shape_as_by_pixels(spark):
    rng = np.random.default_rng(8)
    mask = rng.random((40, 60)) < 0.55
    ring = disk((40, 60), (20, 30), 12) & ~disk((40, 60), (20, 30), 6)
    mask = np.where(disk((40, 60), (20, 30), 15), ring, mask)
    got = measured(spark, mask, 4)
    want = K.particles(I.label(mask)[0], 4)
    assert len(got) == len(want) > 3
    keys = {"n": "area", "ecd": "ecd", "aspect": "aspect", "solidity": "solidity", "circularity": "circularity", "row": "row", "col": "col"}
    own = sorted(tuple(round(x[k], 6) for k in keys) for x in got)
    assert np.allclose(own, sorted(tuple(round(x[k], 6) for k in keys.values()) for x in want), atol=2e-6)


def test_least_and_nothing(spark):
    mask = np.zeros((5, 9), bool)
    mask[0, 0] = mask[3, 3] = mask[3, 4] = True
    assert [x["n"] for x in measured(spark, mask)] == [1, 2] and [x["n"] for x in measured(spark, mask, 2)] == [2]
    (one, _) = measured(spark, mask)
    assert one["direction"] is None and one["aspect"] == one["solidity"] == 1
    assert measured(spark, np.zeros((3, 3), bool)) == []


def perturbed(image, brightness, contrast, gamma):
    m = image.mean()
    x = np.clip(((image - m) * contrast + m) * brightness, 0, 255)
    return np.clip(np.rint(np.round(255 * (x / 255) ** gamma, M.DIGITS)), 0, 255)


def test_shares_under_every_change(spark):
    rng = np.random.default_rng(2)
    images = {k: np.clip(rng.normal(120, 30, (20, 30)), 0, 255).astype(int) for k in range(4)}
    images[9] = np.full((20, 30), 60)
    rows = [(k, r, c, int(g[r, c])) for k, g in images.items() for r in range(20) for c in range(30)]
    px = spark.createDataFrame(rows, "image long, r long, c long, g long")
    out = M.perturbed(M.histograms(px, F.floor(F.col("c") / 6)), 100, 150)
    got = {(x["image"], x["change"], x["kpi"]): x for x in out.collect()}
    assert len(got) == 5 * len(M.CHANGES) * len(M.KPIS)
    for k, image in images.items():
        for name, change in M.CHANGES.items():
            moved = perturbed(image, *change)
            x = got[k, name, "pore_frac_deep"]
            assert math.isclose(x["value"], (image < 100).mean()) and math.isclose(x["moved"], (moved < 100).mean())
            solid = (moved >= 100).sum()
            assert math.isclose(got[k, name, "si_frac_solid"]["moved"], (moved >= 150).sum() / max(solid, 1), abs_tol=1e-12)
    verdicts = M.robustness(out).collect()
    assert len(verdicts) == 5 * len(M.CHANGES)
    for v in verdicts:
        own = {k: got[v["image"], v["change"], k]["shift"] for k in M.KPIS}
        assert v["worst_shift"] == pytest.approx(max(own.values())) and v["n_over"] == sum(s >= M.ROBUST for s in own.values())
        assert v["ok"] == (v["n_over"] == 0) and v["same"] == (v["decision"] == v["decision_moved"])


def test_no_image(spark):
    none = spark.createDataFrame([], "image long, r long, c long, g long")
    out = M.perturbed(M.histograms(none, F.lit(0)), 100, 150)
    assert out.count() == 0 and M.robustness(out).count() == 0
