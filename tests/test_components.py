"""Components over tiles, against a search from pixel to pixel."""

import numpy as np
import pytest

from lamina.operators import grid as G


def frame(spark, mask):
    return spark.createDataFrame([(r, c, bool(mask[r, c])) for r, c in np.ndindex(mask.shape)], "row long, col long, on boolean")


def searched(mask, diagonal):
    """The smallest run number that each set pixel can reach."""
    start = {}
    for r, c in map(tuple, np.argwhere(mask).tolist()):
        start[r, c] = start[r, c - 1] if (r, c - 1) in start else r * 2**32 + c
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not (a and b))]
    out = {}
    for p in start:
        if p in out:
            continue
        seen, todo = {p}, [p]
        while todo:
            r, c = todo.pop()
            new = {(r + a, c + b) for a, b in steps if (r + a, c + b) in start} - seen
            seen |= new
            todo += new
        out |= dict.fromkeys(seen, min(start[q] for q in seen))
    return out


@pytest.mark.parametrize("diagonal", [False, True])
@pytest.mark.parametrize(("height", "width"), [(128, 4096), (4, 8)])
def test_components_are_those_of_a_search(spark, monkeypatch, diagonal, height, width):
    monkeypatch.setattr(G, "TILE_ROWS", height)
    monkeypatch.setattr(G, "PART", width)
    rng = np.random.default_rng(4)
    mask = rng.random((40, 60)) < 0.55
    mask[17], mask[21, 3:40], mask[30:, 30] = True, True, True
    got = {}
    for x in G.components(frame(spark, mask), diagonal).collect():
        for c in range(x["first"], x["last"] + 1):
            assert (x["row"], c) not in got
            got[x["row"], c] = x["component"]
    assert got == searched(mask, diagonal)


def test_rounds_take_parts_at_edges_only(spark, monkeypatch):
    written = []

    def stored(df, name, compression=None):
        rows = before(df, name, compression)
        if name == "labels":
            written.append(rows.count())
        return rows

    before = G.stored
    monkeypatch.setattr(G, "stored", stored)
    mask = np.zeros((300, 24), bool)
    mask[::2, ::3] = True
    mask[:, 0] = True
    found = G.components(frame(spark, mask))
    assert found.count() == 300 + 150 * 7 and max(written) <= 10
    assert found.where("first = 0 AND component = 0").count() == 300
