"""Losses of fold states over blocks of judged samples: the array kernel of the nested validation.

An indicator's median without two of its values depends on their places alone, of which there are six and none; so a small
table for each batch and indicator, made once, gives all of them, and centroids are made for each place instead of each sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Places beside the middle that a value's rank is cut to, and the one that stands for no value.
PLACES, NONE = 6, 6
#: States that are judged together; their differences from a block of samples stay within the processor's cache.
STATES = 8


def medians_without(n: int | None, p0: int | None, mid: list) -> list[list[float]]:
    """The median of `n` sorted values, of which `mid` are those from place `p0` on, without those at two places; places
    count from p0 - 1, and NONE stands for no value."""

    def median(a: int, b: int) -> float:
        gone = sorted(p + p0 - 1 for p in (a, b) if p != NONE)
        left = n - len(gone)
        if left <= 0:
            return float("nan")

        def at(p: int) -> float:
            for g in gone:
                p += g <= p
            found = mid[p - p0] if 0 <= p - p0 < len(mid) else None
            return float("nan") if found is None else found

        return (at((left + 1) // 2) + at(left // 2 + 1)) / 2

    whole = range(PLACES + 1)
    return [[float("nan") if n is None else median(a, b) for b in whole] for a in whole]


def _drawn(c: np.ndarray, deltas: np.ndarray) -> np.ndarray:
    """The candidates' centroids `c` (last axis, NaN for none) drawn to their median by each of `deltas` (a new last axis)."""
    ordered, n = np.sort(c, axis=-1), np.sum(~np.isnan(c), axis=-1, keepdims=True)
    low, high = (np.take_along_axis(ordered, np.maximum(p, 0), -1) for p in ((n + 1) // 2 - 1, np.minimum(n // 2, c.shape[-1] - 1)))
    centre = ((low + high) / 2)[..., None]
    off = c[..., None] - centre
    return centre + np.sign(off) * np.maximum(np.abs(off) - deltas, 0)


def losses(values, places, states, own, inner: int, tables, deltas, temperatures, least: float) -> np.ndarray:
    """Sums (state, delta, temperature) of the losses of samples of the batch `inner`, given as `values` (sample, indicator; NaN
    for none) and `places`; `states` are med, scale, w (state, indicator), place and c (state, indicator, batch)."""
    med, scale, w, place, c = states
    total, found = 0.0, False
    for k in range(values.shape[1]):
        gone = np.where(own == inner, place[:, k], NONE)
        anew = (np.asarray(tables[inner][k])[gone] - med[:, k, None]) / scale[:, k, None] * w[:, k, None]
        each = np.repeat(c[:, k, None, :], PLACES + 1, axis=1)
        each[:, :, inner] = anew
        x = (values[None, :, k] - med[:, k, None]) / scale[:, k, None] * w[:, k, None]
        squares = (np.where(np.isnan(x), 0.0, x)[..., None, None] - _drawn(each, deltas)[:, places[:, k]]) ** 2
        there = ~np.isnan(squares)
        total, found = total + np.where(there, squares, 0.0), found | there
    far = np.where(found, total, np.inf)
    nearest = far.min(axis=2, keepdims=True)
    less = np.where(found, nearest - np.where(found, far, 0.0), -np.inf)
    out = []
    for t in temperatures:
        e = np.exp(less / (2 * t))
        mass = e.sum(axis=2)
        p = np.divide(e[:, :, inner], mass, out=np.zeros_like(mass), where=mass > 0)
        out.append(-np.log(np.maximum(p, least)).sum(axis=1))
    return np.stack(out, axis=-1)


def _rows(column: pa.ListArray, i: int, *shape: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False).reshape(shape)


def judge(tables, deltas, temperatures, least: float):
    """A function for mapInArrow over pairs of a block of samples and a block of states: `class, n, losses`."""
    batches, kpis = len(tables), len(tables[0])
    ds = np.asarray(deltas, float)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for i in range(batch.num_rows):
                at = {name: batch.column(name) for name in batch.schema.names}
                values, places = _rows(at["values"], i, -1, kpis), _rows(at["places"], i, -1, kpis)
                names, own, inner = at["classes"][i].as_py(), _rows(at["own"], i, -1), at["inner"][i].as_py()
                states = [_rows(at[name], i, -1, kpis) for name in ("med", "scale", "w", "place")] + [_rows(at["c"], i, -1, kpis, batches)]
                with np.errstate(invalid="ignore", divide="ignore"):
                    parts = [losses(values, places, [s[j : j + STATES] for s in states], own[j : j + STATES], inner, tables, ds, temperatures, least) for j in range(0, len(names), STATES)]
                sums = np.concatenate(parts).reshape(len(names), -1)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([len(values)] * len(names), pa.int64()), pa.array(list(sums), pa.list_(pa.float64()))], ["class", "n", "losses"])

    return run
