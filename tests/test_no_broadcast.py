"""Stored pixels are small on disk and large in memory; what follows from them must not be broadcast."""

import pytest

from lamina.functions.tables import stored
from lamina.operators import correlation as C
from lamina.operators import grid as G
from lamina.operators import grey as Y
from lamina.operators import particles as P
from lamina.operators import segment as S
from lamina.plans import raster_queries as R
from tests.oracle import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def mask(spark):
    return stored(spark.createDataFrame([(0, r, c) for r in range(6) for c in range(8) if (r * c) % 3], "image long, r long, c long"), "mask")


def test_pair_counts(mask):
    assert "Broadcast" not in plan(C.pair_counts(mask, ["image"], 6, 8, 2))


def test_shapes(spark, mask):
    runs = stored(G.components(mask.selectExpr("r AS row", "c AS col", "true AS on")), "runs")
    assert "Broadcast" not in plan(P.shapes(runs))
    labelled = mask.selectExpr("image", "r", "c", "image AS component")
    assert "Broadcast" not in plan(P.interior_spread(mask.selectExpr("image", "r", "c", "1.0 AS s"), labelled, mask, ["image", "r", "c"]))


def test_segmentation(spark, monkeypatch):
    """The plans of all that it stores, and of its result."""
    seen = {}

    def recorded(df, name):
        seen[name] = seen.get(name, "") + plan(df)
        return stored(df, name)

    for module in (S, G, R):
        monkeypatch.setattr(module, "stored", recorded)
    seen["result"] = plan(R.segmentation(spark, SF))
    assert set(seen) == {"pixels", "smoothed", "thresholds", "tiles", "edges", "labels", "pores", "dark-pores", "bright", "silicon", "segmented", "result"}
    assert [name for name, text in seen.items() if "Broadcast" in text] == []


def test_errors_of_shares(mask):
    labels = stored(mask.selectExpr("image", "r", "c", "IF(r > 2, 'pore', 'si') AS phase"), "segmented")
    assert "Broadcast" not in plan(S.with_errors(labels, 8))


def test_thresholds(mask):
    assert "Broadcast" not in plan(Y.otsu(mask.selectExpr("image", "c AS g"), ["image"]))
