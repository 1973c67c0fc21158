"""Segmentation of drawn images whose truth is known."""

import numpy as np
from pyspark.sql import functions as F

from lamina.operators import segment as S


def drawn(second_dark):
    """Carbon at 60 with a dark round pore, a faint spot beside it, a bright block and a bright speck that the opening removes."""
    rng = np.random.default_rng(4)
    r, c = np.indices((60, 80))
    image = 60 + rng.normal(0, 2, (60, 80))
    pore = (r - 20) ** 2 + (c - 20) ** 2 <= 64
    image[pore] = 12
    block = (abs(r - 40) <= 9) & (abs(c - 55) <= 12)
    image[block] = 115
    image[5, 70] = 140
    other = np.where(pore, 20 if second_dark else 150, 90) + rng.normal(0, 2, image.shape)
    return np.clip(image, 0, 255).astype(int), np.clip(other, 0, 255).astype(int), pore, block


def frame(spark, images):
    rows = [(k, r, c, int(g[r, c]), int(e[r, c])) for k, (g, e, *_) in images.items() for r in range(g.shape[0]) for c in range(g.shape[1])]
    return spark.createDataFrame(rows, "image long, r long, c long, g long, e long")


def test_phases_are_those_drawn(spark):
    images = {0: drawn(True), 3: drawn(False)}
    got = S.segmented(frame(spark, images), 60, 80).collect()
    assert len(got) == 2 * 60 * 80
    for k, (_, _, pore, block) in images.items():
        phase = np.full(pore.shape, "", object)
        for row in got:
            if row["image"] == k:
                phase[row["r"], row["c"]] = row["phase"]
        assert ((phase == "si") == block).mean() > 0.97 and ((phase == ("pore" if k == 0 else "doubtful")) == pore).mean() > 0.97
        assert phase[5, 70] == "carbon"
        if k:
            assert not (phase == "pore").any()


def test_errors_follow_the_strips(spark):
    labels = spark.createDataFrame([(1, r, c, "pore" if c < 8 else "si" if r == 0 else "carbon") for r in range(4) for c in range(40)], "image long, r long, c long, phase string")
    got = {r["kpi"]: (r["value"], r["se"]) for r in S.with_errors(labels, 40).collect()}
    shares = np.array([1.0, 0, 0, 0, 0])
    assert np.allclose(got["pore"], (0.2, shares.std(ddof=1) / np.sqrt(5)))
    assert np.allclose(got["si_solid"], (0.25, 0)) and got["doubtful"] == (0.0, 0.0)


def test_nothing(spark):
    none = frame(spark, {})
    assert S.segmented(none, 60, 80).count() == 0
    assert S.with_errors(none.withColumn("phase", F.lit("pore")), 80).count() == 0
