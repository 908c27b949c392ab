"""Several small models fitted side by side: one Spark pass per step serves them all."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

HISTORY = 10


def _direction(slope: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The limited-memory quasi-Newton direction from past (step, change of slope) pairs."""
    q, used = slope.copy(), []
    for s, y in reversed(past):
        a = (s @ q) / (y @ s)
        q -= a * y
        used.append((a, s, y))
    if past:
        s, y = past[-1]
        q *= (s @ y) / (y @ y)
    for a, s, y in reversed(used):
        q += (a - (y @ q) / (y @ s)) * s
    return -q


def minimise(
    evaluate: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], starts: np.ndarray, tol: float = 1e-5, steps: int = 200
) -> np.ndarray:
    """Minima (models, parameters) of several smooth losses, from ``starts`` of that shape.

    ``evaluate`` gives the losses and slopes of all models at once, each at its own point;
    it is called at most ``steps`` times. A model rests when its largest slope is below
    ``tol``; the others go on by steps that lower their own loss.
    """
    at = starts.astype(np.float64).copy()
    loss, slope = evaluate(at)
    past: list[list] = [[] for _ in at]
    way, reach = -slope, np.minimum(1.0, 1.0 / np.maximum(np.linalg.norm(slope, axis=1), 1e-12))
    resting = np.abs(slope).max(axis=1) < tol
    for _ in range(steps - 1):
        if resting.all():
            break
        trial = np.where(resting[:, None], at, at + reach[:, None] * way)
        found, tilt = evaluate(trial)
        for m in np.flatnonzero(~resting):
            fall = slope[m] @ way[m]
            if found[m] <= loss[m] + 1e-4 * reach[m] * fall + 1e-13 * abs(loss[m]):
                step, change = trial[m] - at[m], tilt[m] - slope[m]
                if step @ change > 1e-14:
                    past[m] = [*past[m][1 - HISTORY :], (step, change)]
                at[m], loss[m], slope[m] = trial[m], found[m], tilt[m]
                way[m], reach[m] = _direction(slope[m], past[m]), 1.0
                if slope[m] @ way[m] >= 0:
                    way[m], past[m] = -slope[m], []
                resting[m] = np.abs(slope[m]).max() < tol
            else:
                reach[m] /= 2
                resting[m] = reach[m] < 1e-12
    return at
