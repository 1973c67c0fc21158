"""Statistics of small arrays, as the array kernels use them."""

from __future__ import annotations

import numpy as np


def share_quantiles(values: np.ndarray, weights: np.ndarray, quantiles: tuple[float, ...]) -> list[float]:
    """Quantiles of the cumulative weight share, linear between points, clamped below the first."""
    order = np.argsort(values, kind="stable")
    share = np.cumsum(weights[order]) / weights.sum()
    return [float(x) for x in np.interp(quantiles, share, values[order])]
